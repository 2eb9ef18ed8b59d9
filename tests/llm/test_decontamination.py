import random

import duckdb

from barloom.llm.decontamination import OP9_SQL, contaminated, op9_minhash_containment, without_items

from .common_frames import documents, empty

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.sql(OP9_SQL)
    want = sorted(tuple(x) for x in r.fetchall())
    assert sorted(tuple(x[k] for k in r.columns) for x in op9_minhash_containment(spark, SF).collect()) == want


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_equals_brute_force_at_all_sizes(spark):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = {k: r.choices(vocabulary, k=r.choice([5, 6, 12, 20, 21, 36, 40, 70, 130, 300])) for k in range(60)}
    docs = {}
    for k in range(150):
        words = r.choices(vocabulary, k=r.choice([0, 3, 60, 700, 6000]))
        for _ in range(r.choice([0, 1, 2])):
            part = list(items[r.randrange(60)])
            for _ in range(r.choice([0, 0, 1, 2])):
                part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = part
        docs[k] = " ".join(words)
    got = {(x.doc_id, x.item_id) for x in contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()}
    want = set()
    for i, w in items.items():
        s = shingles(" ".join(w))
        want |= {(d, i) for d, t in docs.items() if len(s & shingles(t)) >= 0.8 * len(s) - 1e-9}
    assert len(want) > 50 and got == want


def test_odd_rows(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "it was not amused by all of this today."), (4, "It was not amused by all of this today."), (None, "une petite maison dans la prairie,")], "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.item_id or -1) for r in contaminated(docs, items).collect()))
    assert got == sorted([(6, 4)] * 2 + [(7, 4)] * 4 + [(10, 4)] * 2 + [(-1, -1)])
    assert contaminated(empty(spark), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    kept = without_items(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9, 11]
    assert without_items(docs, items.limit(0)).count() == docs.count() and without_items(empty(spark), items).count() == 0


def test_items_that_repeat_and_blocks(spark, monkeypatch):
    import barloom.llm.decontamination as m

    monkeypatch.setattr(m, "ITEM_BLOCK", 4)
    text = "nobody was amused by all of this today"
    items = spark.range(3000).selectExpr("id AS item_id", f"CASE WHEN id < 2990 THEN '{text}' ELSE concat('{text} ', id) END AS text")
    docs = spark.createDataFrame([(1, f"they say {text} again"), (2, "something else was said by them all"), (None, text + " 2999")], "doc_id long, text string")
    got = contaminated(docs, items)
    assert got.where("doc_id = 1").count() == 3000 and got.where("doc_id IS NULL").count() == 3000 and got.count() == 6000  # 4 of 5 shingles are enough
    assert [r.doc_id for r in without_items(docs, items).collect()] == [2]

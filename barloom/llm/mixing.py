"""Mixing sources to target weights by Pareto order sampling (operator 2).

Each source gets a target of words by water-filling: sources in code point order (null last) weigh
`weights`, repeating, and share `share` times all words; a target stops at `most` times its
source's words. Within a source, a document expects min(most, level * weight) copies, its weight
by a length tier; the level makes expected words meet the target. The whole part of a document's
expected copies is certain. The rest is its inclusion probability p; documents are ranked by the
odds of a uniform number that their id seeds over the odds of p, and taken from the front until
the source's remaining words are used up. Fill rounds then add the largest
document that is smaller than what is missing, and the last one the document that comes nearest to it.
Exchange rounds at last give one sampled document back for one that was not sampled, of the pair of sizes
that brings the source nearest to its target (either side may be none), as long as that helps.

No task holds a source: ranks are first counted in bins, rows are ordered only within the one bin of a
source where the budget ends, and exchanges look at a source's different sizes.

Defined results: a null text has size 0 and is never taken; a null source is a source; rows that
repeat a doc_id are documents of their own (equal ids have equal ranks, smaller sizes first); where the
doc_id is null, the text seeds the rank; very long texts are counted whole; an empty table gives no row;
other columns, whatever their names, are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import common

EPS = 1e-9
WEIGHTS = (5.0, 2.0, 1.0)
SHORT, SHORT_WEIGHT, LONG_WEIGHT = 100, 1.0, 2.0
#: Bins of ranks for each unit of their logarithm: a bin holds a thousandth of a source at most.
BINS, FILLS, SWAPS, SEED = 256, 4, 3, "mix-1"


def uniform(key: Column, seed: str) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of the key's digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / F.lit(2.0**52 + 2.0)


def text_hash() -> Column:
    return F.xxhash64("text", F.length("text"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source, words) of each source -> its target. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("ratio", most * F.col("words") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("words").over(everything) - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return rows.select("key", F.col("words").alias("source_size"), F.coalesce(F.least(most * F.col("words"), F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def copy_levels(tiers: DataFrame, most: float = 2.0) -> DataFrame:
    """(key, weight, words, target) -> (key, level): expected copies are min(most, level * weight)."""
    w = Window.partitionBy("key").orderBy(F.desc("weight"))
    above, here = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = F.try_divide(F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0)), F.sum(F.col("weight") * F.col("words")).over(here))
    rows = tiers.withColumn("level", level).where(F.col("level") * F.col("weight") <= most + EPS)
    return rows.groupBy("key").agg(F.max_by("level", "weight").alias("level"))


def _exchange(extras: DataFrame, budgets: DataFrame) -> DataFrame:
    """One exchange a source: (row, taken) of the rows that change. extras: key, row, doc_id, size, rank, taken."""
    place = F.struct("rank", "doc_id", "row")
    by = common.keep(extras.groupBy("key", "size", "taken").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")), "mix-sizes")
    gaps = budgets.join(by.where("taken").groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("used")), "key", "left").select("key", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("gap"))
    none = gaps.select("key", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("row"))
    back = by.where("taken").select("key", "size", F.col("last.row").alias("row")).unionByName(none)
    instead = by.where("NOT taken").select("key", "size", F.col("first.row").alias("row")).unionByName(none)
    wanted = back.join(gaps, "key").select("key", "gap", (F.col("size") + F.col("gap")).alias("at"), F.struct("size", "row").alias("b"), F.lit(None).cast("struct<size:bigint,row:bigint>").alias("i"))
    there = instead.select("key", F.lit(None).cast("double").alias("gap"), F.col("size").cast("double").alias("at"), F.lit(None).cast("struct<size:bigint,row:bigint>").alias("b"), F.struct("size", "row").alias("i"))
    near = Window.partitionBy("key").orderBy("at")
    below, above = near.rangeBetween(Window.unboundedPreceding, 0), near.rangeBetween(0, Window.unboundedFollowing)
    met = wanted.unionByName(there).withColumns({"low": F.last("i", ignorenulls=True).over(below), "high": F.first("i", ignorenulls=True).over(above)}).where("b IS NOT NULL")
    tried = met.select("key", "gap", "at", "b", F.explode(F.array("low", "high")).alias("i")).where("i IS NOT NULL")
    best = tried.groupBy("key").agg(F.min(F.struct(F.abs(F.col("at") - F.col("i.size")).alias("off"), F.col("b.size").alias("s1"), F.col("i.size").alias("s2"), F.col("b.row").alias("back"), F.col("i.row").alias("instead"), F.abs("gap").alias("gap"))).alias("x")).where("x.off < x.gap - 1e-6")
    out = best.select(F.explode(F.array(F.struct(F.col("x.back").alias("row"), F.lit(False).alias("now")), F.struct(F.col("x.instead").alias("row"), F.lit(True).alias("now")))).alias("e"))
    return out.select("e.row", "e.now").where("row IS NOT NULL")


def pareto_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = SEED, bins: int = BINS, fills: int = FILLS, swaps: int = SWAPS) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken and copies of each document (doc_id, text,
    source); doc_id, text_hash and source find the row again."""
    size = common.n_words(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).alias("named"), "source", size.alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"))
    rows = rows.withColumn("weight", F.when(F.col("size") < SHORT, F.lit(SHORT_WEIGHT)).otherwise(F.lit(LONG_WEIGHT)))
    rows = common.keep(rows.withColumn("u", uniform(F.col("named"), seed)).drop("named").withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    tiers = rows.groupBy("key", "weight").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    targets = source_targets(tiers.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("words")), weights, share, most)
    levels = copy_levels(tiers.select("key", "weight", "words").join(targets.select("key", "target"), "key"), most)
    plan = common.keep(targets.join(levels, "key", "left"), "mix-plan")

    expected = F.least(F.lit(most), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    rows = rows.join(plan, "key").withColumn("expected", expected).withColumn("sure", F.floor(F.col("expected") + EPS).cast("long")).withColumn("p", F.col("expected") - F.col("sure"))
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))
    rows = rows.withColumn("rank", F.when((F.col("p") > EPS) & (F.col("size") > 0), odds)).withColumn("bin", F.floor(F.log("rank") * bins))
    rows = common.keep(rows.select("row", "doc_id", "text_hash", "source", "key", "size", "source_size", "target", "sure", "rank", "bin"), "mix-ranked")

    sure = rows.groupBy("key").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("budget"))
    by_bin = rows.where("rank IS NOT NULL").groupBy("key", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("bin")
    ends = by_bin.withColumn("upto", F.sum("words").over(upto)).join(sure, "key").where(F.col("upto") > F.col("budget"))
    ends = common.keep(ends.groupBy("key").agg(F.min("bin").alias("end"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("whole"), F.first("budget").alias("budget")), "mix-ends")
    ranked = Window.partitionBy("key").orderBy("rank", "doc_id", "size", "row")
    at_end = rows.join(ends, "key").where(F.col("bin") == F.col("end")).select("key", "row", "size", "whole", "budget", F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    chosen = common.keep(at_end.where(F.col("whole") + F.col("running") <= F.col("budget")).select("key", "row", "size"), "mix-chosen")

    open_rows = rows.where("rank IS NOT NULL").join(ends, "key").where(F.col("bin") >= F.col("end"))
    for k in range(fills):
        most_size = F.col("gap") if k + 1 < fills else 2.0 * F.col("gap")
        left = ends.join(chosen.groupBy("key").agg(F.sum("size").alias("used")), "key", "left").select("key", (F.col("budget") - F.col("whole") - F.coalesce("used", F.lit(0))).alias("gap"))
        fits = open_rows.join(left, "key").where(F.col("size") < most_size).join(chosen.select("row"), "row", "left_anti")
        best = fits.groupBy("key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "doc_id", "row", "size")).alias("b"))
        chosen = common.keep(chosen.unionByName(best.select("key", "b.row", "b.size")), "mix-chosen")

    # without an end, all of a source's ranked documents fit
    one = F.col("end").isNull() | (F.col("bin") < F.col("end")) | F.col("one").isNotNull()
    out = rows.join(ends.select("key", "end"), "key", "left").join(chosen.select("row", F.lit(1).alias("one")), "row", "left").withColumn("extra", F.col("rank").isNotNull() & one).drop("end", "one")
    changed: DataFrame | None = None
    for _ in range(swaps):
        state = out if changed is None else out.join(changed, "row", "left").withColumn("extra", F.coalesce("now", "extra")).drop("now")
        extras = state.where("rank IS NOT NULL").select("key", "row", "doc_id", "size", "rank", F.col("extra").alias("taken"))
        found = _exchange(extras, sure)
        if changed is not None:
            found = found.unionByName(changed.join(found.select("row"), "row", "left_anti"))
        changed = common.keep(found, "mix-changed")  # two rows a source and round
    if changed is not None:
        out = out.join(changed, "row", "left").withColumn("extra", F.coalesce("now", "extra"))
    copies = (F.col("sure") + F.col("extra").cast("long")).cast("long")
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...), each as often as the mix takes it; of rows equal in these
    three, the one whose columns have the least digest is taken for all."""
    told = pareto_mix(docs, **options).where("copies > 0").groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies"))
    # the columns of docs lie in one struct, so that no name can clash
    rows = docs.select(common.packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"), F.col("source").alias("from"))
    rows = rows.join(told, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("hash").eqNullSafe(F.col("text_hash")) & F.col("from").eqNullSafe(F.col("source")))
    # rows equal in id, text and source are interchangeable: the first stands for all their copies
    rows = rows.groupBy("doc_id", "text_hash", "source").agg(common.first_row("row"), F.first("copies").alias("copies"))
    return common.unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


_UNIFORM = f"(CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) AS DOUBLE) + 1.0) / ({2.0**52 + 2.0!r})"


def mix_sql(documents: str = "documents") -> str:
    """CTEs (without WITH) that end in `mixed`: doc_id, size, source_size, target, taken, copies."""
    fills = ""
    for k in range(FILLS):
        fills += f"""
, left{k} AS (SELECT e.key, budget - whole - coalesce(used, 0) AS gap FROM ends e LEFT JOIN (SELECT key, sum(size) AS used FROM chosen{k} GROUP BY key) c ON e.key = c.key)
, best{k} AS (SELECT key, row, size FROM (SELECT r.key, r.row, r.size, row_number() OVER (PARTITION BY r.key ORDER BY abs(gap - r.size), r.rank, r.doc_id, r.row) AS k FROM ranked r JOIN ends e ON r.key = e.key JOIN left{k} l ON r.key = l.key WHERE r.rank IS NOT NULL AND r.bin >= e."end" AND r.size < {1.0 if k + 1 < FILLS else 2.0}::DOUBLE * gap AND r.row NOT IN (SELECT row FROM chosen{k})) WHERE k = 1)
, chosen{k + 1} AS (SELECT * FROM chosen{k} UNION ALL SELECT * FROM best{k})"""
    swaps = ""
    for k in range(SWAPS):
        swaps += f"""
, by{k} AS (SELECT key, size, taken, arg_min(row, (rank, doc_id, row)) AS first, arg_max(row, (rank, doc_id, row)) AS last, count(*) AS n FROM extras{k} GROUP BY key, size, taken)
, gaps{k} AS (SELECT b.key, budget - coalesce(used, 0) AS gap FROM budgets b LEFT JOIN (SELECT key, sum(size * n)::BIGINT AS used FROM by{k} WHERE taken GROUP BY key) u ON b.key = u.key)
, back{k} AS (SELECT key, size, last AS row FROM by{k} WHERE taken UNION ALL SELECT key, 0, NULL FROM gaps{k})
, instead{k} AS (SELECT key, size, first AS row FROM by{k} WHERE NOT taken UNION ALL SELECT key, 0, NULL FROM gaps{k})
, tried{k} AS (SELECT g.key, abs(gap) AS gap, abs((b.size + gap) - i.size) AS off, b.row AS back, i.row AS instead, row_number() OVER (PARTITION BY g.key ORDER BY abs((b.size + gap) - i.size), b.size, i.size) AS k FROM gaps{k} g JOIN back{k} b ON g.key = b.key JOIN instead{k} i ON g.key = i.key)
, swap{k} AS (SELECT back, instead FROM tried{k} WHERE k = 1 AND off < gap - 1e-6)
, extras{k + 1} AS (SELECT key, row, doc_id, size, rank, CASE WHEN row IN (SELECT back FROM swap{k} WHERE back IS NOT NULL) THEN false WHEN row IN (SELECT instead FROM swap{k} WHERE instead IS NOT NULL) THEN true ELSE taken END AS taken FROM extras{k})"""
    return f"""mixrows AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce('s' || source, 'n') AS key, size, CASE WHEN size < {SHORT} THEN {SHORT_WEIGHT} ELSE {LONG_WEIGHT} END::DOUBLE AS weight, {_UNIFORM} AS u
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, text FROM {documents}))
, tiers AS (SELECT key, weight, any_value(source) AS source, sum(size)::BIGINT AS words FROM mixrows GROUP BY key, weight)
, sources AS (SELECT key, any_value(source) AS source, sum(words)::BIGINT AS words FROM tiers GROUP BY key)
, weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sources)
, ratios AS (SELECT *, 2.0::DOUBLE * words / w AS ratio FROM weighed)
, filling AS (SELECT *, (1.5::DOUBLE * sum(words) OVER ()::BIGINT - 2.0::DOUBLE * coalesce(sum(words) OVER b, 0)::BIGINT) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS lv FROM ratios WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, targets AS (SELECT key, words AS source_size, coalesce(least(2.0::DOUBLE * words, w * (SELECT arg_min(lv, ratio) FROM filling WHERE lv <= ratio)), 0.0) AS target FROM filling)
, leveled AS (SELECT t.key, weight, (target - 2.0::DOUBLE * coalesce(sum(t.words) OVER a, 0)::BIGINT) / nullif(sum(weight * t.words) OVER h, 0) AS lv FROM tiers t JOIN targets g ON t.key = g.key
  WINDOW a AS (PARTITION BY t.key ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY t.key ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
, levels AS (SELECT key, arg_max(lv, weight) AS lv FROM leveled WHERE lv * weight <= 2.0 + {EPS} GROUP BY key)
, expecting AS (SELECT row, doc_id, m.key, size, u, source_size, target, least(2.0::DOUBLE, coalesce(lv * weight, 0.0)) AS expected FROM mixrows m JOIN targets g ON m.key = g.key LEFT JOIN levels l ON m.key = l.key)
, sured AS (SELECT *, floor(expected + {EPS})::BIGINT AS sure, expected - floor(expected + {EPS})::BIGINT AS p FROM expecting)
, oddsed AS (SELECT *, CASE WHEN p > {EPS} AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS rank FROM sured)
, ranked AS (SELECT *, floor(ln(rank) * {BINS}) AS bin FROM oddsed)
, budgets AS (SELECT key, max(target) - sum(sure * size)::BIGINT AS budget FROM ranked GROUP BY key)
, upto AS (SELECT key, bin, words, sum(words) OVER (PARTITION BY key ORDER BY bin)::BIGINT AS upto FROM (SELECT key, bin, sum(size)::BIGINT AS words FROM ranked WHERE rank IS NOT NULL GROUP BY key, bin))
, ends AS (SELECT u.key, min(bin) AS "end", arg_min(upto - words, bin) AS whole, any_value(budget) AS budget FROM upto u JOIN budgets b ON u.key = b.key WHERE upto > budget GROUP BY u.key)
, chosen0 AS (SELECT key, row, size FROM (SELECT r.key, r.row, r.size, whole, budget, sum(r.size) OVER (PARTITION BY r.key ORDER BY rank, doc_id, r.size, r.row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM ranked r JOIN ends e ON r.key = e.key AND r.bin = e."end") WHERE whole + running <= budget){fills}
, extras0 AS (SELECT r.key, r.row, r.doc_id, r.size, r.rank, e."end" IS NULL OR r.bin < e."end" OR c.row IS NOT NULL AS taken FROM ranked r LEFT JOIN ends e ON r.key = e.key LEFT JOIN chosen{FILLS} c ON r.row = c.row WHERE r.rank IS NOT NULL){swaps}
, mixed AS (SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (SELECT r.*, sure + coalesce(x.taken, false)::BIGINT AS copies FROM ranked r LEFT JOIN extras{SWAPS} x ON r.row = x.row))"""


OP2_SQL = f"WITH {mix_sql()} SELECT doc_id, size, source_size, round(target, 4) AS target, taken FROM mixed"

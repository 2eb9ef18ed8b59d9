import hashlib
import random
import zlib

from pyspark.sql import functions as F

from barloom.llm.warc import page_record, read_archives, read_warc, write_pages
from barloom.llm.warc_format import record, salvage


def payloads(n=40, seed=1):
    r = random.Random(seed)
    return [bytes(r.choice(b"abc <>\r\n\x1f\x8b\x08WARC/1.") for _ in range(r.randint(0, 2000))) for _ in range(n)]


def archive(plain):
    recs = [page_record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads())]
    return [zlib.decompress(x, 31) for x in recs] if plain else recs


def page_of(f):
    return int(f.headers["warc-record-id"].split(":")[2])


def test_round_trip_of_members_and_plain_records():
    for plain in (False, True):
        got = list(salvage(b"".join(archive(plain))))
        assert [page_of(f) for f in got] == list(range(40)) and not any(f.reason for f in got)
        for f, p in zip(got, payloads()):
            assert f.block.partition(b"\r\n\r\n")[2] == p


def test_damage_costs_only_the_damaged_records_and_gaps_cover_the_rest():
    r = random.Random(7)
    for plain in (False, True):
        recs = archive(plain)
        starts = [sum(map(len, recs[:k])) for k in range(len(recs))]
        data = b"".join(recs)
        for _ in range(60):
            broken, hit = bytearray(data), set()
            for _ in range(3):
                k = r.randrange(len(data))
                broken[k] ^= 0x40
                hit.add(max(i for i, s in enumerate(starts) if s <= k))
            got = list(salvage(bytes(broken)))
            ok = {f.headers["warc-record-id"] for f in got if f.reason is None}
            for i in set(range(len(recs))) - hit:
                assert any(x.startswith(f"<urn:page:{i}:") for x in ok)
            covered = sorted({(f.offset, f.offset + f.length) for f in got})
            assert covered[0][0] == 0 and max(e for _, e in covered) == len(data)
            assert all(b[0] <= a[1] for a, b in zip(covered, covered[1:]))


def test_garbage_truncation_and_whole_file_gzip():
    recs = archive(True)
    junk = b"\x1f\x8b\x08 no member WARC/1.1 no record"
    got = list(salvage(junk + recs[0] + junk + recs[1][:-9]))
    assert [f.reason is None for f in got] == [False, True, False]
    squeeze = zlib.compressobj(wbits=31)
    whole = squeeze.compress(b"".join(recs[:5])) + squeeze.flush()
    assert len([f for f in salvage(whole) if f.reason is None]) == 5
    cut = [f for f in salvage(whole[: len(whole) * 2 // 3])]
    assert cut[-1].reason and any(f.reason is None for f in cut)
    assert list(salvage(b"")) == []


def test_records_in_stored_blocks_of_a_damaged_member_come_once():
    recs = archive(True)
    squeeze = zlib.compressobj(0, wbits=31)  # stored, so that the records also lie in the archive as they are
    member = bytearray(squeeze.compress(recs[0] + recs[1]) + squeeze.flush())
    member[-5] ^= 1  # the trailer
    got = [page_of(f) for f in salvage(bytes(member) + recs[2]) if f.reason is None]
    assert got == [0, 1, 2]
    assert [page_of(f) for f in salvage(bytes(member) + bytes(member)) if f.reason is None] == [0, 1, 0, 1]


def test_missing_mandatory_header_is_a_gap():
    data = zlib.decompress(record({"WARC-Type": "resource"}, b"x"), 31)
    assert [f.reason for f in salvage(data)] == ["a mandatory header is missing"]


def pages(spark):
    long = "<p>" + "x" * 300 + "</p>"
    rows = [(5, "http://a", long, 1), (2, None, long, 2), (9, "http://b\r\nX: y", long, 3), (2, None, long, 4), (None, "http://n", long, 5), (1, "http://s", "short", 6), (3, "http://s", "short", 7), (4, "http://0", None, 8), (6, "http://e", "", 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_pages_round_trip_with_revisits(spark):
    manifest = write_pages(pages(spark), archive_bytes=700)
    got = read_archives(manifest)
    assert got.where("kind = 'gap'").count() == 0
    rows = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got.collect()), key=repr)
    long = 307
    expect = [(5, "revisit", 2, long), (9, "revisit", 2, long), (2, "response", None, long), (2, "response", None, long), (None, "response", None, long), (1, "response", None, 5), (3, "response", None, 5), (4, "response", None, 0), (6, "response", None, 0)]
    assert rows == sorted(expect, key=repr)
    folder = manifest.first().path.rpartition("/")[0]
    again = read_warc(spark, folder)
    assert again.where("kind = 'record'").count() == 9
    digest = hashlib.sha256(b"<p>" + b"x" * 300 + b"</p>").hexdigest()
    assert again.where(F.col("payload_digest") == digest).count() == 5


def test_no_pages(spark):
    assert read_archives(write_pages(pages(spark).limit(0))).count() == 0

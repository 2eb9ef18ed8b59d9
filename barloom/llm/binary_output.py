"""Token ids in directly addressable binary files (operator 7).

write_ids() puts documents in ascending doc_id order by a range partitioning, encodes them where
they lie and writes files of bounded size to the shared folder; it returns a manifest of one row a
file. read_ids() opens the files and returns one row a document; dac.Dac gives any single id.

Defined results: a null text counts as empty (its only id is the end id); null doc_ids come first;
rows with equal doc_id follow each other in order of a hash of their texts (ties do not matter); an empty table gives no file and
no row; other columns, whatever their names, are ignored. A very long text makes its file larger, nothing else.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import common, pieces
from barloom.llm.dac import Dac, build

MANIFEST = "path string, part int, seq int, n_docs long, n_ids long"
#: Documents whose ids are decoded at a time.
READ_DOCS = 1000
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.worker_state(("ids", tokenizer), lambda: pieces.ByteLevelIds(tokenizer))
        store, base = common.open_fs(folder)
        store.create_dir(base, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        docs, lengths, chunks, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, chunks, total, seq
            # a name of its own for each attempt: files of failed attempts are in no manifest
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(build(docs, lengths, np.concatenate(chunks), end_id))
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(docs)], "n_ids": [total]})
            docs, lengths, chunks, total, seq = [], [], [], 0, seq + 1
            common.give_back()
            return row

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in pieces.slices(texts):
                found, sizes = encoder.ids(texts[a:b], [end_id])
                doc = at = 0
                while doc < len(sizes):  # a file ends with the document that fills it
                    upto = total + np.cumsum(sizes[doc:])
                    n = min(int(np.searchsorted(upto, file_ids)) + 1, len(upto))
                    size = int(upto[n - 1]) - total
                    docs += ids[a + doc : a + doc + n]
                    lengths += sizes[doc : doc + n].tolist()
                    chunks.append(found[at : at + size])
                    doc, at, total = doc + n, at + size, total + size
                    if total >= file_ids:
                        yield flush()
        if docs:
            yield flush()

    return write


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, file_ids: int = 4_000_000) -> DataFrame:
    """Encode documents (doc_id, text) and write them; the manifest, one row a file."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the hash spreads rows of equal id; within an id the order is that of the hash, then of the text
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return common.keep(ranged.mapInArrow(_writer(common.scratch(spark, "dac"), tokenizer, end_id, file_ids), MANIFEST), "dac-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, name = common.open_fs(path)
            with store.open_input_file(name) as f:
                dac = Dac(f.read())
            for k in range(0, dac.docs, READ_DOCS):
                at = dac.starts[k : k + READ_DOCS + 1]
                ids, cuts = dac.slice(int(at[0]), int(at[-1])), (at - at[0]).tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                docs = slice(k, k + len(sums))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(dac.doc_ids[docs], mask=dac.null[docs].astype(bool)), "start": first + at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(sums, pa.int64())})
            del dac, ids
            common.give_back()


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row a document, read back from the files of a manifest."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one slim row a file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    return files.repartition(common.tasks_for(manifest), F.col("path")).mapInArrow(_read, ROWS)


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))

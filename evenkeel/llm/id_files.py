"""Token-id output: whole texts as ids in context-mixed, range-coded, checksummed blocks.

Documents are range-partitioned by doc_id and encoded in that order; a
partition's ids are cut into blocks of whole documents, each coded from a
reset model (``mixing_coder``). The file format is a table of blocks that
Spark writes and reads on any store: shard (partition), block, ids before
it in the shard, doc_ids and id counts of its documents, vocabulary size,
crc32 of the payload, payload. Shards in order hold the documents in
ascending doc_id order, so a document's global start is its shard's plus
its place there.

Defined results: null text is empty and becomes the end id alone; null
doc_ids come first; equal doc_ids are ordered by text; a document longer
than a block is a block of its own; an empty table gives no blocks; a
payload that fails its checksum raises; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import slices
from evenkeel.llm.mixing_coder import decode_block, encode_block
from evenkeel.llm.subwords import encoder
from evenkeel.session import new_table_path

BLOCK_IDS = 1 << 20
END = 0

_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("vocab", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("checksum", pa.int64()),
                    ("payload", pa.binary())])
_BLOCK_DDL = ("shard int, block int, before long, vocab int, doc_ids array<long>, sizes array<long>, "
              "checksum long, payload binary")


def _writer(path: str, spaced: bool, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs, sizes, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            payload = encode_block(flat, enc.vocab)
            row = [[shard], [block], [before], [enc.vocab], [docs], [np.concatenate(sizes).tolist()],
                   [crc32(payload)], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, lens = enc.encode(texts, END)
                names, ends = part.column("doc_id").to_pylist(), np.cumsum(lens)
                at = 0
                while at < len(names):
                    base = ends[at - 1] if at else 0
                    stop = min(int(np.searchsorted(ends, base + block_ids - held)) + 1, len(names))
                    docs += names[at:stop]
                    sizes.append(lens[at:stop])
                    ids.append(flat[base:ends[stop - 1]])
                    held += int(ends[stop - 1] - base)
                    at = stop
                    if held >= block_ids:
                        yield close()
                        block, before = block + 1, before + held
                        docs, sizes, ids, held = [], [], [], 0
        if docs:
            yield close()
    return write


def write_ids(docs: DataFrame, tokenizer: str, spaced: bool = True, block_ids: int = BLOCK_IDS,
              path: str | None = None) -> str:
    """Encode ``docs`` (doc_id, text) into block files at ``path`` (default: a new shared folder); the path.

    ``spaced``: the tokenizer gives a word its leading space (byte-level BPE without normaliser).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The crc splits a run of equal doc_ids over partitions, the tie column a run of equal rows.
    by = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("_tie")]
    ordered = (rows.withColumn("crc", F.crc32(F.col("text").cast("binary")))
               .withColumn("_tie", F.monotonically_increasing_id())
               .repartitionByRange(*by).sortWithinPartitions(*by).drop("crc", "_tie"))
    path = path or new_table_path(spark, "ids")
    ordered.mapInArrow(_writer(tokenizer, spaced, block_ids), _BLOCK_DDL).write.parquet(path)
    return path


_DOC = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("within", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])


def decoded(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """(block row without payload, ids) of a batch of blocks; raises on a bad checksum."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        payload = row.pop("payload")
        if crc32(payload) != row["checksum"]:
            raise ValueError(f"checksum mismatch in shard {row['shard']}, block {row['block']}")
        yield row, decode_block(payload, sum(row["sizes"]), row["vocab"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, ids in decoded(batch):
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4")
            crcs = [crc32(raw[e - n:e]) for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(sizes), pa.int32()),
                pa.array(row["before"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], schema=_DOC)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from decoding the files."""
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row per written partition: a small window, and small enough to broadcast.
    first = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    docs = blocks.mapInArrow(_reader, "doc_id long, shard int, within long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(first), "shard").select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

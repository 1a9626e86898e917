"""Token ids on disk: one wavelet matrix per shard.

Documents are dealt to shards by ranges of ``doc_id``, about ``shard_bytes`` of text each, and
sorted inside; a task encodes its texts and writes one row per shard: the ids of its documents,
where each document ends, and the matrix's bit-planes. The matrix gives back all ids, single ids,
counts and the positions of a token without anything else. A partition with more than
``shard_ids`` ids is several shards, so memory is bounded also where one id repeats.

Starts are prefix sums: inside a shard from the ends, between shards over one row per shard.

Defined results: a null or empty text has only the end id; null ids come first, in the order of
their texts; rows that repeat an id are neighbours in the order of their texts; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import encoder
from keyloom.llm.blocks import pieces, text_bytes
from keyloom.llm.wavelet import WaveletMatrix
from keyloom.staging import Stage

SHARD_BYTES = 16_000_000
SHARD_IDS = 16_000_000
PIECE_BYTES = 4_000_000
END_ID = 1
SHARDS = "shard bigint, doc_id array<bigint>, ends binary, n_ids bigint, planes array<binary>"


def in_order(docs: DataFrame, shard_bytes: int, order: Column | None = None) -> DataFrame:
    """doc_id, text: partitions of ascending ranges of doc_id, or of ``order``, sorted."""
    own = [F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")]
    size = docs.agg(F.sum(F.octet_length(own[1])).alias("n")).first().n or 0
    n = max(1, -(-int(size) // shard_bytes))
    if order is None:
        return docs.select(*own).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    d = docs.select(*own, order.alias("place"))
    return d.repartitionByRange(n, "place").sortWithinPartitions("place", "doc_id").select("doc_id", "text")


def shuffle_order(seed: int = 1) -> Column:
    """An order in which copies of a document stand apart: a hash of every row's place in its table."""
    return F.xxhash64(F.lit(seed), F.monotonically_increasing_id())


def encoded(
    batches: Iterator[pa.RecordBatch],
    path: str,
    end: int,
    special_as_text: bool = False,
    piece_bytes: int = PIECE_BYTES,
    table_bytes: int = encoder.TABLE_BYTES,
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, ends) of a few megabytes of text at a time."""
    coder = encoder.of_worker(path, special_as_text, table_bytes)
    for batch in batches:
        data, borders = text_bytes(batch.column(1))
        known = batch.column(0).to_pylist()
        for a, b in pieces(borders, piece_bytes):
            body = data[borders[a] : borders[b]].tobytes()
            cuts = (borders[a : b + 1] - borders[a]).tolist()
            texts = [body[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
            yield known[a:b], *coder.encode(texts, end)


def write_shards(
    docs: DataFrame,
    stage: Stage,
    path: str,
    end: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    shard_ids: int = SHARD_IDS,
    order: Column | None = None,
    table_bytes: int = encoder.TABLE_BYTES,
) -> DataFrame:
    """Write the shards, by doc_id or in ``order``, and return the table that reads them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        names, ids, ends, n = [], [], [], 0

        def shard():
            matrix = WaveletMatrix.build(np.concatenate(ids))
            return pa.record_batch(
                [
                    pa.array([number], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([np.concatenate(ends).astype("<i8").tobytes()], pa.binary()),
                    pa.array([n], pa.int64()),
                    pa.array([matrix.dumps()], pa.list_(pa.binary())),
                ],
                names=["shard", "doc_id", "ends", "n_ids", "planes"],
            )

        for known, more, borders in encoded(batches, path, end, table_bytes=table_bytes):
            if n and n + len(more) > shard_ids:
                yield shard()
                number, names, ids, ends, n = number + 1, [], [], [], 0
            names, n = names + known, n + len(more)
            ids.append(more.astype(np.uint16) if len(more) and more.max() < 65536 else more)
            ends.append(borders + n - len(more))
        if names:
            yield shard()

    return stage.put(in_order(docs, shard_bytes, order).mapInArrow(pack, SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the shards alone."""
    schema = "shard bigint, doc_id bigint, low bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.loads(row["n_ids"], row["planes"]).decode().astype("<u4")
                ends = np.frombuffer(row["ends"], "<i8")
                low = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(low.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(ends), row["shard"]), pa.int64()),
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(low, pa.int64()),
                        pa.array(ends - low, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "doc_id", "low", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return (
        shards.mapInArrow(read, schema)
        .join(bases, "shard")
        .select("doc_id", (F.col("base") + F.col("low")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: occurrences in the whole store, by rank queries on each shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.loads(row["n_ids"], row["planes"])
                counts = [matrix.count(t) for t in tokens]
                yield pa.record_batch(
                    [pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["token", "n"]
                )

    found = shards.mapInArrow(ask, "token bigint, n bigint")
    return found.groupBy("token").agg(F.sum("n").alias("n"))

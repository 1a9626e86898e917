"""Texts in blocks, for operators that ask many small questions about parts of texts.

A block is a row with some thousand documents: ``doc_id`` (list), ``ends`` (int64 ends of the
UTF-8 texts) and ``body`` (the texts, joined and compressed). A partition is cut into blocks of about
``block_bytes``, so a task holds one block at a time; a longer text is a block of its own. Blocks
are written once, without a shuffle, and their numbers are part of what is written, so a job that
is run again after a lost executor meets the same blocks.

:func:`by_shard` sends the distinct 64-bit keys of each block to the shards that own them, and
:func:`to_blocks` brings one answer for each key back: at most one row per block and shard, of
which every key occurs once, however many documents share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.staging import Stage

BLOCK_BYTES = 8_000_000
BLOCK_SCHEMA = "block bigint, doc_id array<bigint>, ends binary, body binary"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 borders of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[borders[0] : borders[-1]]
    return data, borders - borders[0]


def pieces(borders: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(borders) - 1
    while first < n:
        last = int(np.searchsorted(borders, borders[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def write_blocks(docs: DataFrame, stage: Stage, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, bodies, size = [], [], 0

        def block():
            lengths = np.concatenate([np.diff(b) for _, b in bodies])
            body = b"".join(d.tobytes() for d, _ in bodies)
            return pa.record_batch(
                [
                    pa.array([number], pa.int64()),
                    pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())),
                    pa.array([np.cumsum(lengths).astype("<i8").tobytes()], pa.binary()),
                    pa.array([zstandard.compress(body, 1)], pa.binary()),
                ],
                names=["block", "doc_id", "ends", "body"],
            )

        for batch in batches:
            data, borders = text_bytes(batch.column(1))
            known = batch.column(0).to_pylist()
            for a, b in pieces(borders, block_bytes):
                n = int(borders[b] - borders[a])
                if bodies and size + n > block_bytes:
                    yield block()
                    number, ids, bodies, size = number + 1, [], [], 0
                ids.append(known[a:b])
                # Copied, so that the batch can go.
                bodies.append((data[borders[a] : borders[b]].copy(), borders[a : b + 1].copy()))
                size += n
        if bodies:
            yield block()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return stage.put(rows.mapInArrow(pack, BLOCK_SCHEMA), "blocks")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of a task, of which one at a time is unpacked."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield from batch.slice(k, 1).to_pylist()


def body_of(row: dict) -> bytes:
    return zstandard.decompress(row["body"])


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)


def by_shard(
    blocks: DataFrame,
    n_shards: int,
    keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]],
    sent: str = "<u8",
) -> DataFrame:
    """shard, block, keys, info. ``keys_of(row)`` gives the block's distinct uint64 keys, sorted,
    and a uint32 for each. Keys are sent as numbers of type ``sent``: their low bytes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, info = keys_of(row)
            shard = shard_of(keys, n_shards)
            order = np.argsort(shard, kind="stable")
            keys, info = keys[order].astype(sent), info[order].astype("<u4")
            cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch(
                [
                    pa.array(used, pa.int64()),
                    pa.array(np.full(len(used), row["block"]), pa.int64()),
                    pa.array([keys[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()),
                    pa.array([info[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()),
                ],
                names=["shard", "block", "keys", "info"],
            )

    return blocks.mapInArrow(ask, "shard bigint, block bigint, keys binary, info binary")


ANSWERS = "block bigint, shard bigint, answers binary"


def answers_of(replies: pa.Table) -> dict[int, bytes]:
    return dict(zip(replies.column("shard").to_pylist(), replies.column("answers").to_pylist()))


def to_blocks(
    blocks: DataFrame,
    replies: DataFrame,
    n_shards: int,
    keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]],
    finish: Callable[[dict, np.ndarray, np.ndarray], pa.Table],
    schema: str,
) -> DataFrame:
    """``finish(row, keys, flags)`` for every block, with the flag (one bit) of each of its keys."""

    def bring(own: pa.Table, found: pa.Table) -> pa.Table:
        by = answers_of(found)
        out = []
        for row in own.to_pylist():
            keys, _ = keys_of(row)
            shard = shard_of(keys, n_shards)
            order = np.argsort(shard, kind="stable")
            flags = np.zeros(len(keys), bool)
            cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
            for s, bits in by.items():
                spots = order[cuts[s] : cuts[s + 1]]
                flags[spots] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(spots)) > 0
            out.append(finish(row, keys, flags))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(bring, schema)

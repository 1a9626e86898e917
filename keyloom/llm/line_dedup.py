"""Line dedup with a sharded minimal perfect hash over all distinct line keys.

The key of a line is the line without white space at its ends, A-Z lower-cased. Keys found in at
least ``min_docs`` documents lose all their lines.

1. Every block of documents sends its distinct 64-bit line hashes, with the number of its
   documents that have them, to the shard that owns them (pre-aggregated: a line of a third of
   all documents is one key per block).
2. A shard merges its hashes and builds a minimal perfect hash over them (levels of bit arrays
   with rank counts), a 32-bit fingerprint array and a count array in its order, and writes them.
3. The hashes of each block probe the arrays of their shards; a bit per key goes back, and each
   block rewrites its documents. Lines are never joined.

A shard's memory follows its number of keys; the number of shards follows the input.

Defined results: a null or empty text is one empty line, which is kept (its key has no code
point); repeated rows count as documents of their own; a null id stays null; an empty table gives
an empty result; other columns are ignored. Two different keys with one 64-bit hash would be
counted together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from keyloom.llm import blocks as B
from keyloom.staging import Stage

MIN_DOCS = 10
BLANK = b" \t\n\x0b\x0c\r"
GAMMA = 2.0
MAX_COUNT = 2**32 - 1
RESULT = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"


def line_hashes(text: bytes) -> list[int]:
    """A hash per line; 0 for a line without a key."""
    digest = xxhash.xxh3_64_intdigest
    keys = (line.strip(BLANK).lower() for line in text.split(b"\n"))
    return [(digest(k) or 1) if k else 0 for k in keys]


def _line_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    body, start = B.body_of(row), 0
    seen: list[int] = []
    for end in np.frombuffer(row["ends"], "<i8").tolist():
        seen += set(line_hashes(body[start:end])) - {0}
        start = end
    keys, n = np.unique(np.array(seen, dtype=np.uint64), return_counts=True)
    return keys, n.astype(np.uint32)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct uint64 keys.

    On each level a key falls on a bit; bits hit by exactly one key are set, the other keys try
    the next level. The place of a key is the number of set bits before its own.
    """

    MAX_LEVELS = 64

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # sizes in words of 64 bits; rest is sorted
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.base = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < cls.MAX_LEVELS:
            n_words = int(GAMMA * len(keys)) // 64 + 1
            spot = (_mixed(keys, len(levels)) % np.uint64(64 * n_words)).astype(np.int64)
            alone = np.bincount(spot, minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[spot]]
        return cls(levels, np.sort(keys))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key; any number below the size for a key that is not in the set."""
        out = np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                return out
            spot = _mixed(keys[todo], level) % np.uint64(64 * len(words))
            word, bit = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) > 0
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            place = ranks[word] + np.bitwise_count(below)
            out[todo[here]] = place[here]
            todo = todo[~here]
        if len(self.rest) and len(todo):
            out[todo] = self.base + np.searchsorted(self.rest, keys[todo]).clip(
                max=len(self.rest) - 1
            )
        return out


INDEX = "shard bigint, levels array<binary>, rest binary, prints binary, counts binary"


def _build(group: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in group.column("keys").to_pylist()])
    n = np.concatenate([np.frombuffer(k, "<u4") for k in group.column("info").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, n = keys[first], np.add.reduceat(n, first)
    index = PerfectHash.build(keys)
    places = index.places(keys)
    prints, counts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[places] = keys.astype(np.uint32)
    counts[places] = np.minimum(n, MAX_COUNT)
    return pa.table(
        {
            "shard": [group.column("shard")[0].as_py()],
            "levels": [[w.tobytes() for w in index.levels]],
            "rest": [index.rest.tobytes()],
            "prints": [prints.tobytes()],
            "counts": [counts.tobytes()],
        },
        schema=pa.schema(
            [
                ("shard", pa.int64()),
                ("levels", pa.list_(pa.binary())),
                ("rest", pa.binary()),
                ("prints", pa.binary()),
                ("counts", pa.binary()),
            ]
        ),
    )


def probe(index: dict, keys: np.ndarray) -> np.ndarray:
    """Document counts of keys; 0 where the fingerprint differs."""
    levels = [np.frombuffer(w, "<u8") for w in index["levels"]]
    perfect = PerfectHash(levels, np.frombuffer(index["rest"], "<u8"))
    places = perfect.places(keys)
    prints = np.frombuffer(index["prints"], "<u4")[places]
    counts = np.frombuffer(index["counts"], "<u4")[places]
    return np.where(prints == keys.astype(np.uint32), counts, 0)


def build_index(docs: DataFrame, stage: Stage, block_bytes: int = B.BLOCK_BYTES):
    """(blocks, asked, index, n_shards), all written."""
    blocks = B.write_blocks(docs, stage, block_bytes)
    n_shards = max(16, blocks.count() // 4)
    asked = stage.put(B.by_shard(blocks, n_shards, _line_keys), "line-keys")
    index = stage.put(asked.groupBy("shard").applyInArrow(_build, INDEX), "line-index")
    return blocks, asked, index, n_shards


def digest(
    docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def kept(lines: list[bytes]) -> str:
        return hashlib.sha256(b"\n".join(lines)).hexdigest()

    return _rewritten(docs, min_docs, block_bytes, kept, RESULT)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: the kept lines."""

    def kept(lines: list[bytes]) -> str:
        return b"\n".join(lines).decode("utf-8", "replace")

    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"
    return _rewritten(docs, min_docs, block_bytes, kept, schema)


def _rewritten(docs, min_docs, block_bytes, kept, schema) -> DataFrame:
    stage = Stage(docs.sparkSession)
    blocks, asked, index, n_shards = build_index(docs, stage, block_bytes)

    def answer(keys: pa.Table, arrays: pa.Table) -> pa.Table:
        own = arrays.to_pylist()[0]
        bits = [
            np.packbits(probe(own, np.frombuffer(k, "<u8")) >= min_docs).tobytes()
            for k in keys.column("keys").to_pylist()
        ]
        return pa.table(
            [keys.column("block"), keys.column("shard"), pa.array(bits, pa.binary())],
            names=["block", "shard", "answers"],
        )

    sent = asked.select("shard", "block", "keys").groupBy("shard")
    replies = sent.cogroup(index.groupBy("shard")).applyInArrow(answer, B.ANSWERS)

    def finish(row: dict, keys: np.ndarray, flags: np.ndarray) -> pa.Table:
        frequent = set(keys[flags].tolist())
        body, start, out = B.body_of(row), 0, ([], [], [])
        for end in np.frombuffer(row["ends"], "<i8").tolist():
            text, start = body[start:end], end
            lines = text.split(b"\n")
            stay = [x for x, h in zip(lines, line_hashes(text)) if h not in frequent]
            out[0].append(len(lines))
            out[1].append(len(lines) - len(stay))
            out[2].append(kept(stay))
        return pa.table(
            [
                pa.array(row["doc_id"], pa.int64()),
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int64()),
                pa.array(out[2], pa.string()),
            ],
            names=[c.split()[0] for c in schema.split(", ")],
        )

    return B.to_blocks(blocks, replies, n_shards, _line_keys, finish, schema)

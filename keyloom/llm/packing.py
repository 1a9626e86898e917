"""Best-fit packing of documents into sequences, by counts of lengths.

Documents become token ids, each with an end id. Only documents longer than ``capacity`` are cut:
into whole sequences, with what is left over as the first piece. A piece's place depends on its
length and its number among the pieces of that length alone, so the packing is planned on the
counts of lengths: at most ``capacity`` numbers, whatever the number of documents.

1. Large items, above a third of the capacity, of which no three share a sequence, are matched
   greedily: from the longest down, each meets the longest other that still fits. (Partners of a
   longer item are partners of a shorter one, too, so no matching has more pairs.)
2. Smaller ones, from the longest down, go where they leave the least room. Sequences with the same
   room are one run, and all pieces of a length that a run takes are one entry of the plan.

Pieces are numbered without gathering a length: inside each split of the written pieces, then by
prefix sums over the splits' counts. :func:`place` is one equi-join on (split, length) and a lookup
in the plan; :func:`sequences` writes out the packed ids, at most ``capacity`` of them a group.

Defined results: a null or empty text has only the end id; null ids and rows that share an id are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.staging import Stage

CAPACITY = 2048
END_ID = 0
ROWS = 512  # documents encoded together
# Fixed value: the split of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "split int, row bigint, number bigint, doc_id bigint, piece int, start bigint, length int, ids binary"


# ---- ids ---------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints,
    the others numbered from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a byte-level BPE file, merged by rank.

    In these files a token's id is its rank among the merges, so tiktoken's merges over the same
    vocabulary give the library's ids (tests compare them). Where it gives up, on runs too long for
    its splitter, the library itself encodes the text.
    """

    def __init__(self, path: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        special = {t["content"]: t["id"] for t in parts["added_tokens"] if t["special"]}
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in parts["model"]["vocab"].items()
            if token not in special
        }
        self.path, self.library = path, None
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:  # the splitter's panic is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _encoder(path: str) -> ByteEncoder:
    """The worker's encoder, made once in a Python process."""
    kept = sys.modules.setdefault("_keyloom_encoders", types.ModuleType("_keyloom_encoders")).__dict__
    if f"bytes|{path}" not in kept:
        kept[f"bytes|{path}"] = ByteEncoder(path)
    return kept[f"bytes|{path}"]


def write_pieces(
    docs: DataFrame, stage: Stage, path: str, capacity: int = CAPACITY, end: int = END_ID
) -> DataFrame:
    """One row per piece with its ids; ``number`` counts the pieces of its length in its split."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, coder, row = TaskContext.get().partitionId(), _encoder(path), 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(coder.encode(text or ""), end).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(stop - capacity, 0) if k else 0
                        length = stop - start
                        out.append(
                            (split, row, int(seen[length]), doc_id, k, start, length, ids[start:stop].tobytes())
                        )
                        seen[length] += 1
                        row += 1
                fields = [f.split() for f in PIECES.split(", ")]
                kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
                columns = zip(*out)
                yield pa.record_batch(
                    [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)],
                    names=[name for name, _ in fields],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return stage.put(rows.mapInArrow(cut, PIECES), "pieces")


# ---- plan --------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Entries sorted by (length, first): pieces of a length from number ``first`` on fill sequences
    from ``sequence`` on, ``each`` of them in one, from ``offset`` on."""

    entries: np.ndarray  # columns length, first, sequence, each, offset
    n_sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces."""
        step = int(number.max(initial=0)) + 1
        step = max(step, int(self.entries[:, 1].max(initial=0)) + 1)
        if step * (int(length.max(initial=0)) + 1) < 2**62:
            keys = self.entries[:, 0] * step + self.entries[:, 1]
            at = np.searchsorted(keys, length * step + number, side="right") - 1
        else:  # numbers too large for one key: a search per length
            at = np.empty(len(length), np.int64)
            for one in np.unique(length).tolist():
                low, high = np.searchsorted(self.entries[:, 0], [one, one + 1])
                here = length == one
                at[here] = low + np.searchsorted(self.entries[low:high, 1], number[here], side="right") - 1
        _, first, sequence, each, offset = self.entries[at].T
        nth = number - first
        return sequence + nth // each, offset + nth % each * length


class _Planner:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.n_sequences = 0
        self.rooms: list[int] = []  # sorted: room left, where some sequence has it
        self.runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)

    def take(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.entries.append((length, self.used[length], sequence, each, offset))
        self.used[length] += n
        self.left[length] -= n

    def opened(self, n: int) -> int:
        self.n_sequences += n
        return self.n_sequences - n

    def add(self, room: int, sequence: int, n: int) -> None:
        if n:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((sequence, n))

    def match_large(self) -> None:
        large = sorted(k for k in self.left if 3 * k > self.capacity)
        for length in reversed(large):
            while n := self.left[length]:
                fits = [k for k in large if k <= min(length, self.capacity - length) and self.left[k]]
                partner = fits[-1] if fits else None
                if partner == length and n > 1:
                    sequence = self.opened(n // 2)
                    self.take(length, n // 2 * 2, sequence, 2, 0)
                    self.add(self.capacity - 2 * length, sequence, n // 2)
                    continue
                if partner == length:  # one left: the next longest may still fit
                    partner = fits[-2] if len(fits) > 1 else None
                n = min(n, self.left[partner]) if partner else n
                sequence = self.opened(n)
                self.take(length, n, sequence, 1, 0)
                if partner:
                    self.take(partner, n, sequence, 1, length)
                self.add(self.capacity - length - (partner or 0), sequence, n)

    def fit_small(self) -> None:
        for length in sorted((k for k in self.left if 3 * k <= self.capacity), reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    each = self.capacity // length
                    wanted = -(-n // each)
                    self.add(self.capacity, self.opened(wanted), wanted)
                    continue
                room = self.rooms[at]
                sequence, bins = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    self.rooms.pop(at)
                each = room // length
                n = min(n, bins * each)
                self.take(length, n, sequence, each, self.capacity - room)
                full, rest = divmod(n, each)
                self.add(room - each * length, sequence, full)
                if rest:
                    self.add(room - rest * length, sequence + full, 1)
                used = full + (rest > 0)
                self.add(room, sequence + used, bins - used)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts`` pieces of each length into sequences of ``capacity``."""
    planner = _Planner(counts, capacity)
    planner.match_large()
    planner.fit_small()
    return Plan(np.array(sorted(planner.entries), np.int64).reshape(-1, 5), planner.n_sequences)


# ---- places ------------------------------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset in place of ``number``."""
    counts = pieces.groupBy("split", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("split", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packed = plan(totals, capacity)
    others = [c for c in pieces.columns if c != "number"]
    numbered = pieces.join(bases, ["split", "length"]).select(
        *others, (F.col("base") + F.col("number")).alias("number")
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("number").schema)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length = np.asarray(batch.column(others.index("length"))).astype(np.int64)
                sequence, offset = packed.place(length, np.asarray(batch.column(len(others))))
                columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
                yield pa.record_batch(columns, names=[*others, "sequence_id", "offset"])

    return numbered.mapInArrow(look_up, f"{fields}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, documents: what is trained on. ``ids`` are little-endian 32-bit, and each
    document's struct says where its piece lies. A sequence's pieces fit its capacity."""
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    ids = F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))")
    return rows.select("sequence_id", ids.alias("ids"), F.expr("transform(parts, p -> struct("
        "p.doc_id AS doc_id, p.piece AS piece, p.start AS start, p.offset AS offset, p.length AS length))"
    ).alias("documents"))


def digest(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = write_pieces(docs, Stage(docs.sparkSession), path, capacity, end)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(ids.as_buffer()) for ids in batch.column(len(kept))], pa.int64())
            yield pa.record_batch([*batch.columns[:-1], sums], names=[*kept, "ids_crc32"])

    kept = ["split", "number", "doc_id", "piece", "start", "length"]
    checked = pieces.select(*kept, "ids").mapInArrow(
        check, "split int, number bigint, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"
    )
    placed = place(checked, capacity)
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
        "sequence_id", "offset",
    )

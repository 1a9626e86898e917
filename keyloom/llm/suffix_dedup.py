"""Suffix-array dedup: bytes of 50-byte strings that also start in an earlier document go.

1. *Anchors.* The anchor of a 50-byte string is its 16-byte piece of least hash, so equal strings
   have equal anchors. Every block sends the distinct anchors of its documents to their shards,
   which answer whether more than one document has them. Strings with an unshared anchor are
   unique and go no further.
2. *Contexts.* Neighbouring strings with one shared anchor are one context. Contexts go to the
   shard of their anchor, equal ones of a block only once, so all copies of a string meet in one
   shard. An anchor of more than ``HOT`` documents is split: each of its strings goes by its own
   hash.
3. *Suffix array.* A shard sorts the suffixes of its contexts by the difference cover of period
   three (sort sampled triples, recurse on their names, merge the other suffixes), compares the
   50-byte prefixes of neighbours, and finds the smallest ``doc_id`` of each run of equal ones.
   More than ``PART_BYTES`` of contexts are sorted in parts by a byte of the hash that chose the
   shard, which equal strings have in common.
4. A bit per string goes back to its block, which removes what the marked strings cover.

The number of shards follows the input. A task holds one block, or the contexts of one shard and the
arrays that sort a part of them, and no stage chains two functions, so a core has one Python worker.

Defined results: a null or empty text has no bytes; texts under 50 bytes lose none; a null id comes
after all others and rows that share an id do not remove from each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import blocks as B
from keyloom.llm.suffix_array import letters, suffix_order
from keyloom.llm.word_hashes import mixed, numbers
from keyloom.staging import Stage

LENGTH = 50
PIECE = 16  # bytes of an anchor
SPAN = LENGTH - PIECE + 1  # places of an anchor in a string
HOT = 5_000
SLICE_BYTES = 200_000
BLOCK_BYTES = 2_000_000
PART_BYTES = 200_000  # contexts that are sorted at once: their arrays fit a cache
NO_ID = 2**63 - 1
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_A, _B, _C, _D = numbers(4, 401) | np.uint64(1)


def _words_at(data: np.ndarray, n: int, offset: int) -> np.ndarray:
    """The 8 bytes from every one of the first n places (plus offset) as a number; padded data."""
    return np.lib.stride_tricks.as_strided(
        data[offset : offset + 8].view("<u8"), shape=(n,), strides=(1,)
    )


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``data``: where the anchor of the string that starts there is, and the hash
    of the piece at the place. Only places with LENGTH bytes left in their document mean something.
    Pieces are compared by the upper half of their hashes, then by place: both are in one number."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
    words = _words_at(padded, n + LENGTH + 8, 0).copy()
    hashes = mixed(words[:-8] * _A + mixed(words[8:] * _B))
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done < SPAN:  # windows of ``done`` places; the left one wins ties
        step = min(done, SPAN - done)
        least = np.minimum(least[step:], least[:-step])
        done += step
    return least[:n].astype(np.uint32).astype(np.int64), hashes


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of ``n`` places its ``first`` one and those behind it; they fit 32 bits."""
    before = (first - (np.cumsum(n) - n)).astype(np.int32)
    return np.repeat(before, n) + np.arange(n.sum(), dtype=np.int32)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(B.body_of(row), np.uint8)
    return body, np.concatenate([[0], np.frombuffer(row["ends"], "<i8")])


def _runs(row: dict) -> tuple[np.ndarray, ...]:
    """first and one past the last start, document row and anchor hash of each context."""
    body, borders = _block(row)
    parts = []
    for a, b in B.pieces(borders, SLICE_BYTES):
        low = borders[a]
        where, hashes = anchors(body[low : borders[b]])
        n = np.maximum(np.diff(borders[a : b + 1]) - LENGTH + 1, 0)
        starts = _spread(borders[a:b] - low, n)
        if len(starts):
            at = where[starts]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.append(first[1:], len(starts)) - 1
            begin = low + starts[first]
            rows = np.searchsorted(borders, begin, side="right") - 1
            parts.append((begin, low + starts[last] + 1, rows, hashes[at[first]]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _anchor_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block and how many of its documents have each."""
    _, _, rows, least = _runs(row)
    order = np.lexsort((rows, least))
    rows, least = rows[order], least[order]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
    keys, n = np.unique(least[fresh], return_counts=True)
    return keys, n.astype(np.uint32)


def _count_documents(group: pa.Table) -> pa.Table:
    """For each block, a byte per key: 0 in one document, 1 shared, 2 shared by many."""
    keys = [np.frombuffer(k, "<u4") for k in group.column("keys").to_pylist()]
    n = np.concatenate([np.frombuffer(k, "<u4") for k in group.column("info").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=n)
    kind = ((total > 1).astype(np.uint8) + (total > HOT))[inverse].astype(np.uint8)
    cuts = np.cumsum([0, *map(len, keys)])
    answers = [kind[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return _answers(group, answers)


def _answers(group: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table(
        [group.column("block"), group.column("shard"), pa.array(answers, pa.binary())],
        names=["block", "shard", "answers"],
    )


def _ask_anchors(blocks: DataFrame, n_shards: int) -> DataFrame:
    """shard, block, keys (the low 32 bits, in the shards' order), info."""
    return B.by_shard(blocks, n_shards, _anchor_keys, sent="<u4")


def _pieces_of(row: dict, n_shards: int) -> dict[str, np.ndarray]:
    """The contexts of a block with a shared anchor by shard, part and id, hot ones cut into strings."""
    body, _ = _block(row)
    first, end, rows, least = _runs(row)
    keys, place = np.unique(least, return_inverse=True)
    replies = {x["shard"]: x["answers"] for x in row["kinds"] or ()}
    order = np.argsort(B.shard_of(keys, n_shards), kind="stable")
    kinds = np.zeros(len(keys), np.uint8)
    kinds[order] = np.frombuffer(b"".join(replies[s] for s in sorted(replies)), np.uint8)
    kind = kinds[place]
    one, many = kind == 1, kind == 2
    count = (end - first)[many]
    begins = _spread(first[many], count)
    first, end = np.concatenate([first[one], begins]), np.concatenate([end[one], begins + 1])
    rows = np.concatenate([rows[one], np.repeat(rows[many], count)])
    padded = np.concatenate([body, np.zeros(LENGTH + 16, np.uint8)])
    own = np.zeros(len(begins), np.uint64)
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        words = _words_at(padded, len(body) + 1, offset)
        own = mixed(own * _C + words[begins] * _D)
    chosen_by = np.concatenate([least[one], own])
    shard, part = B.shard_of(chosen_by, n_shards), chosen_by.astype(np.uint8)
    ids = np.array([NO_ID if i is None else i for i in row["doc_id"]], np.int64)
    order = np.lexsort((ids[rows], part, shard))
    first, end, shard, part, owner = first[order], end[order], shard[order], part[order], ids[rows[order]]
    same, copied = _distinct(body.tobytes(), first, end, shard, owner)
    found = {"first": first, "size": end - first, "shard": shard, "part": part}
    return found | {"same": same, "copied": copied, "owner": owner}


def _distinct(body: bytes, first, end, shard, owner) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of the first equal one (smallest id first), and whether it is a
    later document's copy."""
    seen: dict[tuple[int, bytes], int] = {}
    same = np.arange(len(first))
    for k, (a, b, s) in enumerate(zip(first.tolist(), end.tolist(), shard.tolist())):
        same[k] = seen.setdefault((s, body[a : b + LENGTH - 1]), k)
    return same, owner > owner[same]


# What is kept of the pieces next to their block, compressed.
PIECES = {"first": "<i4", "size": "<i4", "shard": "<i4", "part": "u1", "same": "<i4", "copied": "?", "owner": "<i8"}


def _packed(found: dict[str, np.ndarray]) -> list[bytes]:
    return [zstandard.compress(found[c].astype(kind).tobytes(), 1) for c, kind in PIECES.items()]


def _pieces(row: dict) -> dict[str, np.ndarray]:
    return {
        c: np.frombuffer(zstandard.decompress(row[c]), kind).astype(np.int64)
        for c, kind in PIECES.items()
    }


CONTEXTS = "shard bigint, block bigint, ids binary, sizes binary, parts binary, body binary"


def _messages(row: dict, n_shards: int) -> pa.RecordBatch:
    """A row for each shard that gets contexts of the block, equal ones once."""
    found, body = _pieces(row), B.body_of(row)
    chosen = _first_ones(found)
    cuts = np.searchsorted(found["shard"][chosen], np.arange(n_shards + 1))
    used = np.flatnonzero(np.diff(cuts))
    packer = zstandard.ZstdCompressor(level=9)
    ids, sizes, parts, texts = [], [], [], []
    for s in used.tolist():
        k = chosen[cuts[s] : cuts[s + 1]]
        ids.append(found["owner"][k].astype("<i8").tobytes())
        sizes.append(found["size"][k].astype("<i4").tobytes())
        parts.append(found["part"][k].astype(np.uint8).tobytes())
        spans = zip(found["first"][k].tolist(), found["size"][k].tolist())
        texts.append(packer.compress(b"".join(body[x : x + n + LENGTH - 1] for x, n in spans)))
    return pa.record_batch(
        [
            pa.array(used, pa.int64()),
            pa.array(np.full(len(used), row["block"]), pa.int64()),
            *(pa.array(x, pa.binary()) for x in (ids, sizes, parts, texts)),
        ],
        names=[c.split()[0] for c in CONTEXTS.split(", ")],
    )


def _mark(group: pa.Table) -> pa.Table:
    """A bit per string of each block: it starts in a document with a smaller id too."""
    sizes = [np.frombuffer(x, "<i4").astype(np.int64) for x in group.column("sizes").to_pylist()]
    owner = np.concatenate([np.frombuffer(x, "<i8") for x in group.column("ids").to_pylist()])
    part = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("parts").to_pylist()])
    body = b"".join(map(zstandard.ZstdDecompressor().decompress, group.column("body").to_pylist()))
    n = np.concatenate(sizes)
    end, at = np.cumsum(n + LENGTH - 1), np.cumsum(n) - n
    marks = np.zeros(int(n.sum()), bool)
    for k in _parts(part, n + LENGTH - 1):
        marks[_spread(at[k], n[k])] = _marks_of(body, end[k], n[k], owner[k])
    cuts = np.cumsum([0, *(int(x.sum()) for x in sizes)]).tolist()
    return _answers(group, [np.packbits(marks[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])])


def _parts(part: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The contexts that are sorted together: about PART_BYTES, where one value of ``part`` has less."""
    held = np.bincount(part, size, 256)
    number = ((np.cumsum(held) - held) // PART_BYTES)[part]
    order = np.argsort(number, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(number[order])) + 1)


def _marks_of(body: bytes, end: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each string of contexts of n strings each that end in ``body`` before ``end``."""
    # Equal contexts of different blocks are sorted once, as the one with the smallest id.
    by_owner = np.argsort(owner, kind="stable")
    seen: dict[bytes, int] = {}
    same = np.empty(len(n), np.int64)
    spans = zip((end - n - LENGTH + 1)[by_owner].tolist(), end[by_owner].tolist())
    for k, (a, b) in zip(by_owner.tolist(), spans):
        same[k] = seen.setdefault(body[a:b], k)
    chosen = np.fromiter(seen.values(), np.int64, len(seen))
    text = np.frombuffer(b"".join(seen), np.uint8)
    del seen
    marked = _marked(text, n[chosen], owner[chosen])
    offset = np.zeros(len(n), np.int64)
    offset[chosen] = np.cumsum(n[chosen]) - n[chosen]
    return marked[_spread(offset[same], n)] | np.repeat(owner > owner[same], n)


def _marked(text: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string of distinct contexts of n strings each, by the suffix array of their text:
    whether a run of equal 50-byte prefixes has a smaller id."""
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    starts = _spread(begin, n)
    number = np.full(len(text), -1, np.int32)
    number[starts] = np.arange(len(starts))
    owner = np.repeat(ids, n)
    order = number[suffix_order(letters(text))]
    order = order[order >= 0]
    at = starts[order]
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        words = _words_at(padded, len(text) + 1 - offset, offset)[at]
        new[1:] |= words[1:] != words[:-1]
    heads = np.flatnonzero(new)
    smallest = np.minimum.reduceat(owner[order], heads)
    marked = np.zeros(len(order), bool)
    marked[order] = owner[order] > np.repeat(smallest, np.diff(np.append(heads, len(order))))
    return marked


def _release(spark) -> None:
    """Let Spark's cleaner see that the rounds so far are written and their shuffles are unused."""
    for _ in range(2):
        spark.range(1).count()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def _cut_blocks(docs: DataFrame, stage: Stage, block_bytes: int) -> tuple[DataFrame, int]:
    """Blocks with their pieces, written, and the number of shards."""
    blocks = B.write_blocks(docs, stage, block_bytes)
    n_shards = max(16, blocks.count())
    asked = _ask_anchors(blocks, n_shards)
    kinds = asked.groupBy("shard").applyInArrow(_count_documents, B.ANSWERS)
    grouped = kinds.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "answers"))).alias("kinds")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            packed = _packed(_pieces_of(row, n_shards))
            yield pa.record_batch(
                [
                    pa.array([row["block"]], pa.int64()),
                    pa.array([row["doc_id"]], pa.list_(pa.int64())),
                    *(pa.array([x], pa.binary()) for x in (row["ends"], row["body"], *packed)),
                ],
                names=["block", "doc_id", "ends", "body", *PIECES],
            )

    # Answers and blocks meet here; what comes of it is written next to the block.
    schema_cut = B.BLOCK_SCHEMA + "".join(f", {c} binary" for c in PIECES)
    pieces = stage.put(blocks.join(grouped, "block", "left").mapInArrow(cut, schema_cut), "pieces")
    for path in {f.rsplit("/", 1)[0] for f in blocks.limit(1).inputFiles()}:
        stage.drop(path)
    return pieces, n_shards


def removed(docs: DataFrame, kept, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``kept(doc_id, text, gone)`` for each document, where gone marks its removed bytes."""
    stage = Stage(docs.sparkSession)
    blocks, n_shards = _cut_blocks(docs, stage, block_bytes)
    _release(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_messages(row, n_shards) for row in B.rows_of(batches))

    contexts = blocks.mapInArrow(send, CONTEXTS)
    marks = contexts.groupBy("shard").applyInArrow(_mark, B.ANSWERS)
    listed = marks.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "answers"))).alias("marks")
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("doc_id", pa.int64())])
        for row in B.rows_of(batches):
            body, borders = _block(row)
            gone = _gone(row, len(body), n_shards)
            rows = []
            for k, i in enumerate(row["doc_id"]):
                a, b = int(borders[k]), int(borders[k + 1])
                rows.append((i, *kept(body[a:b], gone[a:b])))
            arrays = [pa.array([r[0] for r in rows], types.field(0).type)]
            arrays += [pa.array([r[c] for r in rows]) for c in range(1, len(names))]
            yield pa.record_batch(arrays, names=names)

    return blocks.join(listed, "block", "left").mapInArrow(finish, schema)


def _first_ones(found: dict) -> np.ndarray:
    return np.flatnonzero(found["same"] == np.arange(len(found["same"])))


def _gone(row: dict, n_bytes: int, n_shards: int) -> np.ndarray:
    """Which bytes of a block are removed."""
    found = _pieces(row)
    same, copied, n = found["same"], found["copied"] > 0, found["size"]
    chosen = _first_ones(found)
    marked = np.zeros(int(n[chosen].sum()), bool)
    at, cuts = 0, np.searchsorted(found["shard"][chosen], np.arange(n_shards + 1))
    for x in row["marks"] or ():
        s = x["shard"]
        size = int(n[chosen[cuts[s] : cuts[s + 1]]].sum())
        marked[at : at + size] = np.unpackbits(np.frombuffer(x["answers"], np.uint8), count=size)
        at += size
    # Bits of the chosen pieces, spread to all equal ones.
    offset = np.zeros(len(n), np.int64)
    offset[chosen] = np.cumsum(n[chosen]) - n[chosen]
    spot = _spread(offset[same], n)
    start = _spread(found["first"], n)
    hit = start[marked[spot] | np.repeat(copied, n)] if len(spot) else start
    before = np.zeros(n_bytes + 1, np.int32)  # marked starts before each place
    before[hit + 1] = 1
    np.cumsum(before, out=before)
    near = before[1:].copy()
    near[LENGTH:] -= before[1 : max(1, n_bytes - LENGTH + 1)]
    return near > 0


def digest(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def kept(text: np.ndarray, gone: np.ndarray) -> tuple:
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        rest = hashlib.sha256(text[~gone].tobytes()).hexdigest()
        return len(text), int(gone.sum()), spans, rest

    return removed(docs, kept, RESULT, block_bytes)


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text: what is left, cut characters replaced."""

    def kept(text: np.ndarray, gone: np.ndarray) -> tuple:
        return (text[~gone].tobytes().decode("utf-8", "replace"),)

    return removed(docs, kept, "doc_id bigint, text string", block_bytes)

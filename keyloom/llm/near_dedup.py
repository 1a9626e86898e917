"""MinHash near-dedup by a multi-index Hamming join.

The set of a text is its distinct word shingles. A signature has 64 minima of 16 bits each; the
distance of two signatures is the number of minima that differ, about ``64 * (1 - similarity)``.
All pairs within ``reach`` = 27 are guaranteed: the signature is split into 14 chunks, and 27
errors leave a chunk with at most one (pigeonhole). Each chunk is therefore entered once per
minimum with that one left out, which enumerates its allowed errors; signatures that share an
entry meet in its bucket, and links are confirmed on the full sets. (At a similarity of exactly
0.8 a distance beyond 27 has a probability of 1.4e-5, a binomial tail; at 0.81 of 5.1e-6. Such a
pair is only compared if it meets in a star.)

1. Texts with equal sets are one class, found by the digest of the set; the smallest ``doc_id``
   stands for it. Copies never meet in pairs.
2. Entries are sorted into buckets by ranges of (entry, size, class), so a bucket of any size is
   spread over tasks. In each of its bands of size, within which sets are near enough in size, the
   first member is the centre; every class is confirmed against the centre with which it shares most
   entries. Only confirmed links connect classes.
3. What is left to ask is in buckets that still hold several components. There, members outside the
   bucket's largest component meet all members in tiles of about ``TILE``, by signature and at first
   without sets: a pair counts in one bucket only, that of the first entry which it shares, and only
   if it is within reach. Members of such pairs then bring histograms of their sets, which
   bound what a pair can share, and what is left brings the sets: their tile confirms pairs not yet
   connected, nearest first. A tile returns members or a forest, never all pairs.

Every pair within reach is then inside a component or has been refuted. No bucket or component is
collected, and no class outside a component's own buckets is compared with it.

Defined results: a text without words has an empty set, is linked with nothing and kept; a null id
is linked with nothing and kept, with a null component; rows that share an id are one document
(their classes are linked); an empty table gives an empty result; other columns are ignored.
Shingles are compared by 64-bit hashes. Ids from 2^62 on are not supported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import word_hashes as H
from keyloom.llm.blocks import pieces, text_bytes
from keyloom.llm.components import components
from keyloom.llm.key_filter import having, lacking
from keyloom.staging import Stage

SHINGLE = 4
PERCENT = 80
MINIMA = 64
REACH = 27
CHUNKS = REACH // 2 + 1  # one error per chunk: REACH < 2 * CHUNKS
SLICE_BITS = 8  # 256 partners of one centre are confirmed together
TILE = 512  # members of a tile
HOT = 64  # a class of at least a 64th of all rows is salted
SALTS = 32
CELLS = 256  # of a set's histogram
SPARE_IDS = 2**62  # of further classes of an id that stands for several
PIECE_BYTES = 2_000_000
SIGNED = "doc_id bigint, n_shingles bigint, digest binary, sig binary"


def chunk_ends() -> list[tuple[int, int]]:
    cuts = [round(i * MINIMA / CHUNKS) for i in range(CHUNKS + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 array (sets, MINIMA); sets are not empty."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    factors, shifts = H.numbers(MINIMA, 51) | np.uint64(1), H.numbers(MINIMA, 77)
    out = np.empty((len(sets), MINIMA), np.uint16)
    for k in range(MINIMA):
        least = np.minimum.reduceat((joined * factors[k] + shifts[k]) >> np.uint64(20), starts)
        out[:, k] = (H.mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, borders = text_bytes(texts)
    for a, b in pieces(borders, PIECE_BYTES):
        part = data[borders[a] : borders[b]]
        hashes, ends = H.words(part, borders[a : b + 1] - borders[a])
        yield a, b, H.shingles(hashes, ends, shingle)


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), shingle):
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                digests = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(sigs, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return _id_text(docs).mapInArrow(sign, SIGNED)


def _id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))


def _entries(sigs: list[bytes]) -> np.ndarray:
    """int64 array (signatures, MINIMA): the buckets that each signature enters. The low six bits are
    the number of the entry."""
    names = H.numbers(MINIMA, 101)
    places = H.numbers(MINIMA, 131) | np.uint64(1)
    rows = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), MINIMA)
    terms = H.mixed(rows.astype(np.uint64) + names) * places
    keys = np.empty((len(sigs), MINIMA), np.uint64)
    for a, b in chunk_ends():
        whole = terms[:, a:b].sum(axis=1, dtype=np.uint64)
        for k in range(a, b):
            keys[:, k] = H.mixed(whole - terms[:, k] + names[k])
    return (keys >> np.uint64(6) << np.uint64(6) | np.arange(MINIMA, dtype=np.uint64)).view(np.int64)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first entry that each pair of signatures shares; MINIMA where there is none."""
    other = a != b
    first = np.full(len(a), MINIMA)
    for low, high in reversed(chunk_ends()):
        errors = other[:, low:high].sum(axis=1)
        spot = np.where(errors == 1, other[:, low:high].argmax(axis=1), 0)
        first = np.where(errors <= 1, low + spot, first)
    return first


def buckets(classes: DataFrame, percent: int) -> DataFrame:
    """key, band, id, first, edge: members of buckets that may hold several. Sets of one band are near
    enough in size to be linked; ``first`` is the first member of the bucket's band in this split.
    Buckets at the edge of a split may go on in the next one."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _entries(batch.column(1).to_pylist()).ravel()
                sizes = np.log(np.asarray(batch.column(2))) / np.log(100 / min(percent, 99))
                columns = [np.repeat(x, MINIMA) for x in (sizes.astype(np.int32), np.asarray(batch.column(0)))]
                yield pa.record_batch([pa.array(keys), *map(pa.array, columns)], names=["key", "band", "id"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row waits for the next one: with first, shared, and whether its bucket is the split's first.
        wait = None

        def out(keys, bands, ids, firsts, edge, kept):
            columns = [pa.array(x[kept]) for x in (keys, bands, ids, firsts, edge)]
            return pa.record_batch(columns, names=["key", "band", "id", "first", "edge"])

        for batch in batches:
            keys, bands, ids = [np.asarray(c) for c in batch.columns]
            if not len(keys):
                continue
            if wait:
                keys, bands, ids = [np.append(x, y) for x, y in zip(wait, (keys, bands, ids))]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            run = new | np.concatenate([[True], bands[1:] != bands[:-1]])
            firsts = ids[np.flatnonzero(run)][np.cumsum(run) - 1]
            shared = np.concatenate([[bool(wait and wait[4])], ~new[1:]])
            shared[:-1] |= ~new[1:]
            edge = np.cumsum(new) == 1 if not wait or wait[5] else np.zeros(len(keys), bool)
            if wait:
                firsts[np.cumsum(run) == 1] = wait[3]
            wait = keys[-1], bands[-1], ids[-1], firsts[-1], bool(shared[-1]), bool(edge[-1])
            yield out(keys[:-1], bands[:-1], ids[:-1], firsts[:-1], edge[:-1], (shared | edge)[:-1])
        if wait:
            last = [np.array([x]) for x in wait[:4]]
            yield out(*last, np.array([True]), np.array([True]))

    dealt = classes.select("id", "sig", "n_shingles").mapInArrow(enter, "key bigint, band int, id bigint")
    dealt = dealt.repartitionByRange("key", "band", "id").sortWithinPartitions("key", "band", "id")
    return dealt.mapInArrow(runs, "key bigint, band int, id bigint, first bigint, edge boolean")


def stars(held: DataFrame) -> DataFrame:
    """a, b: every class with the centre with which it shares most entries, and centres of one band with
    the first of them; a < b."""
    # The last bucket of a split is known as an edge by its last row only.
    ends = held.where("edge").select("key", "band", "first").distinct()
    lows = ends.groupBy("key", "band").agg(F.min("first").alias("low"))
    linked_ends = ends.join(lows, ["key", "band"]).where("low < first")
    linked_ends = linked_ends.select(F.col("low").alias("a"), F.col("first").alias("b"))
    counted = held.where("id <> first").groupBy("id", "first").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("m"))
    best = best.select((-F.col("m.f")).alias("a"), F.col("id").alias("b"))
    return best.unionAll(linked_ends).distinct()


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    spots = np.searchsorted(b, a)
    spots[spots == len(b)] = 0
    return int((b[spots] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, stage: Stage) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets."""
    ordered = pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    # Consecutive pairs of one centre are a slice: a centre of any size is many slices.
    numbered = F.shiftright(F.monotonically_increasing_id(), SLICE_BITS).alias("slice")
    sliced = stage.put(ordered.select("a", "b", numbered), "slices")
    partners = sliced.join(sets.toDF("b", "words"), "b").select(
        F.col("a").alias("centre"), F.col("slice").alias("part"), "b", F.col("words").alias("more")
    )
    centres = sliced.select("a", "slice").distinct().join(sets.toDF("a", "words"), "a")

    def judge(centre: pa.Table, others: pa.Table) -> pa.Table:
        kept = []
        if centre.num_rows:
            own = np.frombuffer(centre.column("words")[0].as_py(), np.uint64)
            for b, words in zip(others.column("b").to_pylist(), others.column("more")):
                if linked(own, np.frombuffer(words.as_buffer(), np.uint64), percent):
                    kept.append(b)
        a = centre.column("a")[0].as_py() if centre.num_rows else 0
        return pa.table(
            [pa.array([a] * len(kept), pa.int64()), pa.array(kept, pa.int64())], names=["a", "b"]
        )

    both = centres.groupBy("a", "slice").cogroup(partners.groupBy("centre", "part"))
    return both.applyInArrow(judge, "a bigint, b bigint")


def _tiles(members: DataFrame) -> DataFrame:
    """key, left, right, side, id, root: of buckets with several components, every pair of a tile of
    members outside the largest one (side 0) and a tile of all members (side 1)."""
    # Most buckets hold one component; the smallest and largest root tell, whatever a bucket's size.
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.where("low < high").select("key")
    sizes = members.join(mixed, "key", "left_semi").groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("key").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most"))
    sizes = sizes.select(
        "key",
        F.ceil((F.col("n") - F.col("most.k")) / TILE).cast("int").alias("n_left"),
        F.ceil(F.col("n") / TILE).cast("int").alias("n_right"),
        F.col("most.root").alias("most"),
    )
    rows = members.join(sizes, "key")
    tile = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    kept = ["key", "left", "right", "side", "id", "root"]
    left = rows.where("root <> most").withColumns({"left": tile("n_left"), "side": F.lit(0)})
    left = left.withColumn("right", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)))
    right = rows.withColumns({"right": tile("n_right"), "side": F.lit(1)})
    right = right.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)))
    return left.select(*kept).unionAll(right.select(*kept))


PLACE = ["key", "left", "right"]


FIELDS = "key bigint, left int, right int, side int, id bigint, root bigint, n_shingles bigint, sig binary"
PAIRS = 100_000  # pairs whose signatures are compared together


def _near(group: pa.Table | pa.RecordBatch, percent: int) -> np.ndarray:
    """Rows (distance, i, j) of the pairs of rows that are within reach and near in size, have other
    roots and count in their bucket; of rows that are sorted by place, several places at once."""
    place = np.stack([np.asarray(group.column(c)) for c in PLACE])
    side, roots, sizes = [np.asarray(group.column(c)) for c in ("side", "root", "n_shingles")]
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(side), MINIMA)
    where = np.cumsum(np.concatenate([[0], (place[:, 1:] != place[:, :-1]).any(axis=0)]))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    # Each left row meets the right rows of its place, which stand side by side.
    start = np.searchsorted(where[right], where[left])
    each = np.searchsorted(where[right], where[left], side="right") - start
    done = np.concatenate([[0], np.cumsum(each)])
    near = [np.zeros((0, 3), np.int64)]
    at = 0
    while at < len(left):
        stop = max(int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1, at + 1)
        i = np.repeat(left[at:stop], each[at:stop])
        nth = np.arange(len(i)) - np.repeat(done[at:stop] - done[at], each[at:stop])
        j = right[np.repeat(start[at:stop], each[at:stop]) + nth]
        least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        fit = (roots[i] != roots[j]) & (100 * least >= percent * most)
        i, j = i[fit], j[fit]
        far = (sigs[i] != sigs[j]).sum(axis=1)
        fit = far <= REACH
        i, j, far = i[fit], j[fit], far[fit]
        fit = _first_shared(sigs[i], sigs[j]) == (place[0, i] & (MINIMA - 1))
        near.append(np.stack([far, i, j], axis=1)[fit])
        at = stop
    return np.concatenate(near)


def _overlap_bound(rows: pa.Table, pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can be linked by the histograms of their sets: no more is shared than the smaller
    count of each cell. Two full cells say nothing."""
    cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(rows.num_rows, CELLS)
    sizes, kept = np.asarray(rows.column("n_shingles")), []
    for at in range(0, len(pairs), PAIRS // 8):
        _, i, j = pairs[at : at + PAIRS // 8].T
        least = np.minimum(cells[i], cells[j])
        both = least.sum(axis=1, dtype=np.int64)
        kept.append((100 * both >= percent * (sizes[i] + sizes[j] - both)) | (least == 255).any(axis=1))
    return np.concatenate(kept) if kept else np.zeros(0, bool)


def _members_of_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """FIELDS of the members of pairs within reach by signature and, where ``tiles`` has them, by cells."""
    fields = FIELDS + (", cells binary" if "cells" in tiles.columns else "")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # of the place that the batch before ended in
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if not rows.num_rows:
                continue
            same = np.all([np.asarray(rows.column(c)) == rows.column(c)[-1].as_py() for c in PLACE], axis=0)
            cut = int(same.argmax())
            rest = rows.slice(cut)
            yield from found(rows.slice(0, cut))
        if rest is not None:
            yield from found(rest)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            rows = rows.combine_chunks()
            pairs = _near(rows, percent)
            if "cells" in rows.column_names:
                pairs = pairs[_overlap_bound(rows, pairs, percent)]
            kept = rows.take(pa.array(np.unique(pairs[:, 1:])))
            yield from kept.select(names).to_batches()

    names = [f.split()[0] for f in FIELDS.split(", ")]
    # Dealt by the whole place: a bucket is on one task before.
    dealt = tiles.select(*[f.split()[0] for f in fields.split(", ")])
    dealt = dealt.repartition(*PLACE).sortWithinPartitions(*PLACE)
    return dealt.mapInArrow(compare, FIELDS)


def _tile_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what the tiles hold, confirmed on the full sets."""

    def confirm(group: pa.Table) -> pa.Table:
        ids, roots = np.asarray(group.column("id")), np.asarray(group.column("root"))
        words = [np.frombuffer(w.as_buffer(), np.uint64) for w in group.column("words")]
        pairs = _near(group, percent)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        order = np.lexsort((ids[pairs[:, 2]], ids[pairs[:, 1]], pairs[:, 0]))
        for _, i, j in pairs[order].tolist():
            x, y = top(int(roots[i])), top(int(roots[j]))
            if x != y and linked(words[i], words[j], percent):
                parent[max(x, y)] = min(x, y)
                out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
        a, b = [pa.array([pair[k] for pair in out], pa.int64()) for k in (0, 1)]
        return pa.table([a, b], names=["a", "b"])

    dealt = near.join(having(sets, "id", near.select("id")), "id").repartition(*PLACE)
    return dealt.groupBy(*PLACE).applyInArrow(confirm, "a bigint, b bigint")


def _classes(named: DataFrame, stage: Stage) -> DataFrame:
    """digest, id, low, sig, n_shingles, n: one row per distinct set. The smallest doc_id is the class's id; where it
    stands for several, only one class has it."""
    found = named.groupBy("digest").agg(
        F.min("doc_id").alias("low"),
        F.first("sig").alias("sig"),
        F.min("n_shingles").alias("n_shingles"),
        F.count(F.lit(1)).alias("n"),
    )
    found = stage.put(found, "sets-by-digest")
    twice = found.groupBy("low").agg(F.min("digest").alias("chosen"), F.max("digest").alias("other"))
    twice = twice.where("chosen <> other").select("low", "chosen")
    spare = F.lit(SPARE_IDS) + F.monotonically_increasing_id()
    own = F.when(F.coalesce(F.col("chosen") == F.col("digest"), F.lit(True)), F.col("low")).otherwise(spare)
    found = found.join(twice, "low", "left")
    return stage.put(found.select("digest", own.alias("id"), "low", "sig", "n_shingles", "n"), "classes")


def _shared_ids(named: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that hold rows of one document."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    several = several.where("x <> y").select("doc_id")
    held = named.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct()
    held = held.join(classes.select("digest", F.col("id").alias("b")), "digest")
    lows = held.groupBy("doc_id").agg(F.min("b").alias("a"))
    return held.join(lows, "doc_id").where("a < b").select("a", "b").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    stage = Stage(docs.sparkSession)
    own = stage.put(signed(docs, shingle), "signed")
    named = own.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = _classes(named, stage)
    held = stage.put(buckets(classes, percent), "buckets")
    pairs = stage.put(stars(held), "stars")
    # Every class of a bucket counts: two that are alone in neighbouring bands meet in no star.
    nodes = held.select("id").distinct()
    members = stage.put(classes.join(nodes, "id").select("id", "low", "sig", "n_shingles", "digest"), "members")
    starred = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    sets = stage.put(_word_sets(docs, members.join(starred, "id", "left_semi"), shingle), "sets")

    shared = _shared_ids(named, classes)
    links = stage.put(confirmed(pairs, sets.select("id", "words"), percent, stage).unionAll(shared), "links")
    rooted = _rooted(members.select("id", "sig", "n_shingles"), components(links, stage))
    placed = held.select("key", "id").join(rooted.select("id", "root"), "id")
    tiles = _tiles(stage.put(placed, "placed")).join(rooted.select("id", "sig", "n_shingles"), "id")
    near = stage.put(_members_of_pairs(tiles, percent), "near")
    others = near.select("id").distinct().join(starred, "id", "left_anti")
    others = _word_sets(docs, members.join(others, "id", "left_semi"), shingle)
    sets = sets.unionByName(stage.put(others, "more-sets"))
    near = near.join(sets.select("id", "cells"), "id")
    near = stage.put(_members_of_pairs(near, percent), "nearer")
    sets = sets.select("id", "words")
    links = stage.put(links.unionAll(_tile_links(near, sets, percent)), "links")
    labels = _rooted(classes.select("id", "digest", "n"), components(links, stage))
    labelled = _labelled(own.select("doc_id", "n_shingles", "digest"), stage.put(labels, "labels"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return labelled.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of their digest. At most HOT classes hold a HOT-th of all rows each;
    they are listed, and their rows salted, so that no task gets a class whole."""
    floor = labels.agg((F.sum("n") / HOT).alias("floor")).first().floor or 0
    hot = F.broadcast(labels.where(F.col("n") >= floor).select("digest", F.lit(True).alias("hot")))
    salted = F.pmod(F.xxhash64("doc_id", F.rand(7)), F.lit(SALTS)).cast("int")
    rows = rows.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), salted).otherwise(0))
    copies = F.when(F.col("n") >= floor, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    labels = labels.select("digest", F.col("root").alias("component"), F.explode(copies).alias("salt"))
    return rows.join(labels, ["digest", "salt"], "left")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their id; an id without links is its own."""
    found = rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return found.withColumn("root", F.coalesce("root", "id"))


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, text of the members."""
    return having(_id_text(docs), "doc_id", members.select("low"))


def _word_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """id, words, cells: the sets of the members and their histograms, one row each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), shingle):
                words = [s.tobytes() for s in sets]
                digests = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
                cells = [np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS) for s in sets]
                cells = [np.minimum(c, 255).astype(np.uint8).tobytes() for c in cells]
                columns = [pa.array(x, pa.binary()) for x in (digests, words, cells)]
                yield pa.record_batch(columns, names=["digest", "words", "cells"])

    found = _texts_of(docs, members).mapInArrow(cut, "digest binary, words binary, cells binary")
    found = found.dropDuplicates(["digest"])
    return found.join(members.select("digest", "id"), "digest").select("id", "words", "cells")


def dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns, whatever their
    names. Rows with an empty text or a null id stay; an empty table gives an empty one."""
    gone = groups(docs, shingle, percent).where(~F.col("kept")).select("doc_id")
    return lacking(docs, F.col("doc_id").cast("bigint"), gone)

"""The prefix trie of conversations, by union-find over neighbours in sorted order.

Conversations that begin with the same turns stand side by side when they are sorted, and the length
of what two neighbours share (their LCP) is the depth at which their paths part. So the trie needs
no comparison but of neighbours: edges between neighbours are taken by falling LCP, and a union-find
joins what they connect. Every join makes a branching node at that depth, or widens it; the depths
between a node and the one above it are a chain with the same members, written out at the end.

How it is spread:

* A turn is two 64-bit hashes of its role, text and depth, and the length of its text; texts stay in
  the scan. A path is cut into segments of ``SEGMENT`` turns, so no row grows with a conversation. A
  prefix is known by the xor of its turns' hashes, which a segment adds up and a sum over segments
  carries on.
* Equal segments fold into one row with its number of conversations and the smallest of them, before
  anything is sorted. Rows are sorted by (segment, prefix before it, turns) in ranges and written in
  blocks; a block knows what its first and last row share with the blocks beside it.
* Each block is a forest of its own. Its sums (members, smallest member, new children, leaves, bytes
  of members and of new nodes) are sums over rows, where a node is new at the first row that has it.
  Nodes that go beyond the block, those that its neighbours share and the roots of segments, are
  written as parts, contracted to their sums, and merged by prefix; all others are complete.
* What lies in later segments is added from sums over each conversation's own segments. A node counts
  for the smallest conversation that has it, so none counts twice.
* Ids of the conversations that end at a node are hashed in order: in ranges first, as pieces of the
  joined text, then piece by piece, in a stream that holds one piece.

Defined results: a null role or text is empty; rows without a conv_id belong to none; turns with
the same number stand in the order of their hashes, and equal ones are turns like any other; without
conversations there is no node, not even the root; other columns are ignored. Turns are compared by
128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.staging import Stage

SEGMENT = 4096  # turns
BLOCK_TURNS = 100_000
HEAD = 8  # turns that a conversation may take from another: at most h = crc32 % 9
KEY = ["k", "size", "e1", "e2"]  # of a segment's end: every prefix that ends there has it
BLOCKS = (
    "block bigint, k binary, size binary, h binary, e binary, n binary, low binary, n_ends binary, "
    "ends array<binary>, codes binary, lengths binary, first_key binary, first_codes binary, "
    "last_key binary, last_codes binary"
)
NODES = (
    "block bigint, part boolean, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, "
    "parent_low bigint, n bigint, low bigint, children bigint, leaves bigint, w bigint, fresh bigint, "
    "ends binary"
)


# ---- conversations -----------------------------------------------------------------------------


def ordered(conversations: DataFrame, stage: Stage) -> DataFrame:
    """conv_id, pos, h1, h2, n_bytes, split, row: turns with their places, a conversation in any
    number of splits."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(911), text, role).alias("h2"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"]
    rows = stage.put(turns, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    rows = rows.drop("turn").withColumn("row", number)
    return stage.put(rows.withColumn("split", F.shiftright("row", 33)), "ordered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, turnless): conv_id, d, h1, h2, n_bytes of every rebuilt conversation, and the ids of
    those without turns."""
    splits = turns.groupBy("conv_id", "split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("conv_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    own = splits.groupBy("conv_id").agg(F.sum("k").alias("n")).select(
        "conv_id",
        "n",
        (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 5).alias("origin"),
    )
    sizes = own.select(F.col("conv_id").alias("origin"), F.col("n").alias("n_origin"))
    own = own.join(sizes, "origin", "left").withColumn("n_head", F.least("h", F.coalesce("n_origin", F.lit(0))))
    splits = splits.join(own.select("conv_id", "h", "n_head"), "conv_id").drop("k")
    placed = turns.join(splits, ["conv_id", "split"]).withColumn(
        "pos", F.col("row") - F.col("first") + F.col("before")
    )
    kept = ["h1", "h2", "n_bytes"]
    rest = placed.where("pos >= h").select("conv_id", (F.col("n_head") + F.col("pos") - F.col("h")).alias("d"), *kept)
    heads = placed.where(F.col("pos") < HEAD).select(F.col("conv_id").alias("origin"), F.col("pos").alias("d"), *kept)
    heads = heads.join(own.select("conv_id", "h", "origin"), "origin").where("d < h")
    turnless = own.where("n_head = 0 AND n <= h").select("conv_id")
    return rest.unionByName(heads.select("conv_id", "d", *kept)), turnless


def segmented(paths: DataFrame, segment: int) -> DataFrame:
    """conv_id, k, size, h1, h2 (prefix before), e1, e2 (prefix with it), last, after (bytes of later
    segments), turns."""
    tagged = paths.select(
        "conv_id",
        F.floor(F.col("d") / segment).cast("int").alias("k"),
        F.struct(
            "d",
            F.xxhash64("d", "h1").alias("x1"),
            F.xxhash64("d", "h2").alias("x2"),
            "n_bytes",
        ).alias("t"),
    )
    cut = tagged.groupBy("conv_id", "k").agg(
        F.sort_array(F.collect_list("t")).alias("turns"),
        F.count(F.lit(1)).cast("int").alias("size"),
        F.sum("t.n_bytes").alias("bytes"),
        F.bit_xor("t.x1").alias("b1"),
        F.bit_xor("t.x2").alias("b2"),
    )
    order = Window.partitionBy("conv_id").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    return cut.select(
        "*",
        F.coalesce(F.bit_xor("b1").over(before), zero).alias("h1"),
        F.coalesce(F.bit_xor("b2").over(before), zero).alias("h2"),
        F.lead("k").over(order).isNull().alias("last"),
        F.coalesce(F.sum("bytes").over(later), zero).alias("after"),
    ).select(
        "conv_id", "k", "size", "h1", "h2", F.col("h1").bitwiseXOR(F.col("b1")).alias("e1"),
        F.col("h2").bitwiseXOR(F.col("b2")).alias("e2"), "last", "after", "turns",
    )


def ends_of(enders: DataFrame) -> DataFrame:
    """KEY, ends: the SHA-256 of the conv_ids that end at each key, ascending and joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            same = np.all([c[1:] == c[:-1] for c in columns[:4]], axis=0)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
            ids = columns[4].tolist()
            texts = [",".join(map(str, ids[a:b])).encode() for a, b in zip(cuts, cuts[1:])]
            first = batch.take(pa.array(cuts[:-1]))
            yield pa.record_batch([*first.columns, pa.array(texts, pa.binary())], names=[*KEY, "from_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def rows():
            columns = list(zip(*done)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*KEY, "ends"])

        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(4)])
            for key, ids in zip(keys, batch.column(5)):
                if key == now:
                    state.update(b",")
                else:
                    if state:
                        done.append((*now, state.digest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.as_buffer())
            yield rows()
            done.clear()
        if state:
            done.append((*now, state.digest()))
            yield rows()

    kinds = "k int, size int, e1 bigint, e2 bigint"
    rows = enders.select(*KEY, "conv_id")
    rows = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = rows.mapInArrow(join, f"{kinds}, from_id bigint, ids binary")
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "from_id")
    return pieces.mapInArrow(digest, f"{kinds}, ends binary")


# ---- blocks ------------------------------------------------------------------------------------


def write_blocks(rows: DataFrame, stage: Stage, block_turns: int) -> DataFrame:
    """The sorted distinct segments in blocks of about ``block_turns``, one row a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n_held = TaskContext.get().partitionId() << 32, [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            part = {c: np.asarray(table.column(c).combine_chunks()) for c in table.column_names[:9]}
            turns = pa.concat_arrays(table.column("turns").chunks).flatten()
            codes = np.stack([np.asarray(turns.field("x1")), np.asarray(turns.field("x2"))], axis=1)
            cuts = np.concatenate([[0], np.cumsum(part["size"])])
            h = np.stack([part["h1"], part["h2"]], axis=1)
            place = [np.concatenate([[part["k"][i]], h[i]]).astype("<i8").tobytes() for i in (0, -1)]
            wide = lambda a: np.ascontiguousarray(a).astype("<i8").tobytes()
            values = [
                number, wide(part["k"]), wide(part["size"]), wide(h),
                wide(np.stack([part["e1"], part["e2"]], axis=1)), wide(part["n"]), wide(part["low"]),
                wide(part["n_ends"]), table.column("ends").to_pylist(), wide(codes),
                wide(np.asarray(turns.field("n_bytes"))), place[0], wide(codes[: cuts[1]]), place[1],
                wide(codes[cuts[-2] :]),
            ]
            fields = [f.split() for f in BLOCKS.split(", ")]
            kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
            return pa.record_batch(
                [pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, fields)],
                names=[name for name, _ in fields],
            )

        for batch in batches:
            sizes = np.cumsum(np.asarray(batch.column(1)))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                stop = int(np.searchsorted(sizes, done + block_turns - n_held, side="right"))
                stop = min(max(stop, at + (not n_held)), batch.num_rows)
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    n_held += int(sizes[stop - 1] - done)
                    at = stop
                if at < batch.num_rows:
                    yield block()
                    number, held, n_held = number + 1, [], 0
        if held:
            yield block()

    order = ["k", "h1", "h2", "turns"]
    rows = rows.select("k", "size", "h1", "h2", "e1", "e2", "n", "low", "n_ends", "ends", "turns")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage.put(rows.mapInArrow(pack, BLOCKS), "blocks")


def with_borders(blocks: DataFrame, stage: Stage) -> DataFrame:
    """The blocks with ``before`` and ``after``: the turns that the first row shares with the row
    before the block, and the last one with the row after it; -1 where that is in another segment."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                a, b = [np.frombuffer(row[c], "<i8").reshape(-1, 2) for c in ("last_codes", "first_codes")]
                n = min(len(a), len(b))
                other = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
                shared = int(other[0]) if len(other) else n
                found.append(shared if row["last_key"] == row["first_key"] else -1)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["block", "next", "shared"]
            )

    # One number a block.
    following = blocks.select("block", F.lead("block").over(Window.orderBy("block")).alias("next"))
    lasts = blocks.select("block", "last_key", "last_codes")
    firsts = blocks.select(F.col("block").alias("next"), "first_key", "first_codes")
    pairs = following.where("next IS NOT NULL").join(lasts, "block").join(firsts, "next")
    pairs = pairs.select("block", "next", "last_key", "last_codes", "first_key", "first_codes")
    shared = stage.put(pairs.mapInArrow(share, "block bigint, next bigint, shared bigint"), "borders")
    after = shared.select("block", F.col("shared").alias("after"))
    before = shared.select(F.col("next").alias("block"), F.col("shared").alias("before"))
    kept = blocks.drop("first_key", "first_codes", "last_key", "last_codes")
    return kept.join(before, "block", "left").join(after, "block", "left").fillna(-1, ["before", "after"])


class _Block:
    """A block's rows, and what each shares with the one before and after it."""

    def __init__(self, row: dict, segment: int):
        read = lambda c: np.frombuffer(row[c], "<i8")
        self.k, self.size, self.n, self.low = read("k"), read("size"), read("n"), read("low")
        self.h, self.e, codes = [read(c).reshape(-1, 2) for c in ("h", "e", "codes")]
        self.ends, self.goes_on = row["ends"], self.n > read("n_ends")
        self.rows, self.segment, self.number = len(self.size), segment, row["block"]
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.total = np.concatenate([[0], np.cumsum(read("lengths"))])
        self.xor = np.concatenate([np.zeros((1, 2), np.int64), np.bitwise_xor.accumulate(codes, axis=0)])
        self.group = np.zeros(self.rows, np.int64)
        self.group[1:] = np.cumsum((self.k[1:] != self.k[:-1]) | (self.h[1:] != self.h[:-1]).any(axis=1))
        shared = self._shared(codes)
        self.edges = np.where(self.group[1:] == self.group[:-1], shared, -1)  # between neighbours
        self.left, self.right = max(row["before"], 0), max(row["after"], 0)
        self.prev = np.maximum(np.concatenate([[self.left], self.edges]), 0)
        self.next = np.maximum(np.concatenate([self.edges, [self.right]]), 0)
        self.leaf = (self.next < self.size) & ~self.goes_on
        self.fresh = self.bytes(np.arange(self.rows), self.size) - self.bytes(np.arange(self.rows), self.prev)

    def _shared(self, codes: np.ndarray) -> np.ndarray:
        least = np.minimum(self.size[:-1], self.size[1:])
        pair = np.repeat(np.arange(len(least)), least)
        turn = np.arange(len(pair)) - np.repeat(np.cumsum(least) - least, least)
        other = (codes[self.start[pair] + turn] != codes[self.start[pair + 1] + turn]).any(axis=1)
        found, first = np.unique(pair[other], return_index=True)
        shared = least.copy()
        shared[found] = turn[other][first]
        return shared

    def bytes(self, row, depth):
        """Bytes of a row's turns up to a depth."""
        return self.total[self.start[row] + depth] - self.total[self.start[row]]

    def prefix(self, row, depth):
        at = self.start[row]
        return self.h[row] ^ self.xor[at + depth] ^ self.xor[at]


def first_rows(blocks: DataFrame, segment: int) -> DataFrame:
    """KEY, low, block, place, fresh (bytes of nodes that are new at the row), leaf of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, segment)
                columns = [
                    pa.array(b.k.astype(np.int32)), pa.array(b.size.astype(np.int32)), pa.array(b.e[:, 0].copy()),
                    pa.array(b.e[:, 1].copy()), pa.array(b.low), pa.array(np.full(b.rows, b.number)),
                    pa.array(np.arange(b.rows)), pa.array(b.fresh), pa.array(b.leaf.astype(np.int64)),
                ]
                yield pa.record_batch(columns, names=[*KEY, "low", "block", "place", "fresh", "leaf"])

    return blocks.mapInArrow(
        read,
        "k int, size int, e1 bigint, e2 bigint, low bigint, block bigint, place bigint, fresh bigint, leaf bigint",
    )


def beyond(segments: DataFrame, firsts: DataFrame) -> DataFrame:
    """block, beyond (place, w, fresh, leaves): for rows whose conversations go on, what lies in later
    segments. Each conversation adds the rows that count for it, those where it is the smallest."""
    longer = segments.where(~((F.col("k") == 0) & F.col("last"))).select("conv_id", *KEY, "last", "after")
    counted = firsts.select(F.col("low").alias("conv_id"), "k", "fresh", "leaf")
    own = longer.join(counted, ["conv_id", "k"], "left").fillna(0, ["fresh", "leaf"])
    later = Window.partitionBy("conv_id").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    summed = own.select(
        *KEY, "last", "after", F.sum("fresh").over(later).alias("fresh"), F.sum("leaf").over(later).alias("leaf")
    ).where("NOT last")
    by_key = summed.groupBy(*KEY).agg(
        F.sum("after").alias("w"), F.sum("fresh").alias("fresh"), F.sum("leaf").alias("leaves")
    )
    found = by_key.join(firsts.select(*KEY, "block", "place"), KEY)
    return found.groupBy("block").agg(F.collect_list(F.struct("place", "w", "fresh", "leaves")).alias("beyond"))


# ---- forests -----------------------------------------------------------------------------------


def forest(b: _Block, beyond: list[dict]) -> list[np.ndarray]:
    """Chains of a block: columns a, b (first and last row), above (depth the chain hangs from), depth
    (its lowest), n, low, w, fresh, leaves, children, parent, node."""
    n, low = b.n.tolist(), b.low.tolist()
    top = b.size.tolist()
    rows = np.arange(b.rows)
    last = b.bytes(rows, b.size) - b.bytes(rows, b.size - 1)
    w, fresh, leaves = (b.n * last).tolist(), last.tolist(), b.leaf.astype(np.int64).tolist()
    for more in beyond:
        at = more["place"]
        w[at] += more["w"]
        fresh[at] += more["fresh"]
        leaves[at] += more["leaves"]
    children = [0] * b.rows
    node, n_nodes = [-1] * b.rows, 0  # the branching node on top of a component
    end = list(range(b.rows))  # its last row; a component is known by its first
    first = list(range(b.rows))
    total, start = b.total.tolist(), b.start.tolist()
    chains = []

    def find(x: int) -> int:
        while first[x] != x:
            first[x] = x = first[first[x]]
        return x

    def lift(x: int, depth: int, parent: int) -> tuple[int, int, int]:
        """Write the chain of a component from its top up to below ``depth``; (w, fresh, new) there."""
        seen = b.left if x == 0 else 0
        chains.append(
            (x, end[x], depth, top[x], n[x], low[x], w[x], fresh[x], leaves[x], children[x], parent, node[x])
        )
        at = start[x]
        above = total[at + top[x] - 1]
        up = w[x] + n[x] * (above - total[at + depth])
        new = fresh[x] + above - total[at + max(depth, min(seen, top[x] - 1))]
        return up, new, int(depth + 1 > seen)

    def root(x: int, depth: int) -> None:
        """Make the top of a component a node at ``depth``."""
        nonlocal n_nodes
        if top[x] > depth:
            number, n_nodes = n_nodes, n_nodes + 1
            up, new, child = lift(x, depth, number)
            own = total[start[x] + depth] - total[start[x] + depth - 1] if depth else 0
            seen = b.left if x == 0 else 0
            w[x], fresh[x] = up + n[x] * own, new + (own if depth > seen else 0)
            children[x], top[x], node[x] = child, depth, number
        elif node[x] < 0:
            node[x], n_nodes = n_nodes, n_nodes + 1

    for i in np.argsort(-b.edges, kind="stable").tolist():
        depth = int(b.edges[i])
        if depth < 0:
            break
        x, y = find(i), find(i + 1)
        root(x, depth)
        up, new, child = lift(y, depth, node[x])
        own = total[start[x] + depth] - total[start[x] + depth - 1] if depth else 0
        w[x] += up + n[y] * own
        fresh[x] += new
        children[x] += child
        n[x], low[x], leaves[x] = n[x] + n[y], min(low[x], low[y]), leaves[x] + leaves[y]
        first[y], end[x] = x, end[y]
    for i in np.flatnonzero(np.concatenate([[True], b.group[1:] != b.group[:-1]])).tolist():
        x = find(i)
        root(x, 0)
        chains.append((x, end[x], -1, 0, n[x], low[x], w[x], fresh[x], leaves[x], children[x], -1, node[x]))
    return [np.array(c, np.int64) for c in zip(*chains)]


def nodes_of(b: _Block, beyond: list[dict]) -> pa.RecordBatch:
    a, z, above, depth, n, low, w, fresh, leaves, children, parent, node = forest(b, beyond)
    lows, shared = np.zeros(node.max() + 2, np.int64), np.zeros(node.max() + 2, bool)
    each = depth - above
    chain = np.repeat(np.arange(len(a)), each)
    d = above[chain] + 1 + np.arange(len(chain)) - np.repeat(np.cumsum(each) - each, each)
    row, lowest = a[chain], depth[chain]
    seen = np.where(row == 0, b.left, 0)
    ending = (d == lowest) & (b.size[row] == lowest)
    part = (row == 0) & (d <= b.left) | (z[chain] == b.rows - 1) & (d <= b.right) | (d == 0) | ending & b.goes_on[row]
    # Depths above the lowest: the same members, one child, more bytes.
    upto = b.bytes(row, np.maximum(lowest - 1, 0))
    more = np.where(d < lowest, upto - b.bytes(row, np.maximum(d - 1, 0)), 0)
    new = np.where(d < lowest, upto - b.bytes(row, np.maximum(d - 1, np.minimum(seen, lowest - 1)).clip(0)), 0)
    kids = np.where(d < lowest, d + 1 > seen, children[chain])
    # Roots of later segments are ends of the segments before: only their children are counted here.
    later = (d == 0) & (b.k[row] > 0)
    known = node[chain] * (d == lowest) + -1 * (d != lowest)
    lows[known[known >= 0]], shared[known[known >= 0]] = low[chain][known >= 0], part[known >= 0]
    own = d > above[chain] + 1  # the parent is in the same chain
    parent_part = np.where(own, np.concatenate([[True], part[:-1]]), shared[parent[chain]])
    parent_low = np.where(own, low[chain], lows[parent[chain]])
    p = b.prefix(row, d)
    q = b.prefix(row, np.maximum(d - 1, 0))
    ends = [b.ends[i] if e else None for i, e in zip(row.tolist(), ending.tolist())]
    sums = [np.where(later, 0, x) for x in (n[chain], leaves[chain], w[chain] + n[chain] * more, fresh[chain] + new)]
    return pa.record_batch(
        [
            pa.array(np.full(len(d), b.number)),
            pa.array(part),
            pa.array(b.k[row] * b.segment + d),
            pa.array(p[:, 0].copy()),
            pa.array(p[:, 1].copy()),
            pa.array(q[:, 0].copy(), mask=d == 0),
            pa.array(q[:, 1].copy(), mask=d == 0),
            pa.array(parent_low, mask=parent_part | (d == 0)),
            pa.array(sums[0]),
            pa.array(low[chain], mask=later),
            pa.array(kids.astype(np.int64)),
            pa.array(sums[1]),
            pa.array(sums[2]),
            pa.array(sums[3]),
            pa.array(ends, pa.binary()),
        ],
        names=[f.split()[0] for f in NODES.split(", ")],
    )


def forests(blocks: DataFrame, segment: int) -> DataFrame:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield nodes_of(_Block(row, segment), row["beyond"] or [])

    return blocks.mapInArrow(grow, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """Complete nodes and merged parts, with the smallest member of the parent."""
    place = ["depth", "p1", "p2"]
    values = ["depth", "parent_low", "n", "low", "children", "leaves", "w", "fresh", "ends"]
    parts = nodes.where("part")
    # max also picks the one value that is not null
    whole = parts.groupBy(*place).agg(
        F.max(F.when(F.col("q1").isNotNull(), F.struct("q1", "q2"))).alias("q"),
        F.min("low").alias("low"),
        F.max("ends").alias("ends"),
        F.max("parent_low").alias("known_low"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "w", "fresh")],
    )
    above = whole.select(
        (F.col("depth") + 1).alias("depth"), F.struct(F.col("p1").alias("q1"), F.col("p2").alias("q2")).alias("q"),
        F.col("low").alias("parent_low"),
    )
    tops = whole.join(above, ["depth", "q"], "left")
    tops = tops.withColumn("parent_low", F.coalesce("known_low", "parent_low")).select(*values)
    # A block asks for a part's smallest member once, however many children the part has there.
    asked = parts.select("block", *place).distinct().join(whole.select(*place, F.col("low").alias("top_low")), place)
    asked = asked.select(
        "block", (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "top_low"
    )
    complete = nodes.where("NOT part")
    known = complete.where("parent_low IS NOT NULL").select(*values)
    below = complete.where("parent_low IS NULL").drop("parent_low")
    below = below.join(asked, ["block", "depth", "q1", "q2"]).withColumnRenamed("top_low", "parent_low")
    return known.unionByName(below.select(*values)).unionByName(tops)


def trie(conversations: DataFrame, segment: int = SEGMENT, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    stage = Stage(conversations.sparkSession)
    paths, turnless = rebuilt(ordered(conversations, stage))
    segments = stage.put(segmented(paths, segment), "segments")
    turnless = stage.put(turnless, "turnless")
    zero, none = F.lit(0).cast("bigint"), F.lit(0)
    enders = segments.where("last").select(*KEY, "conv_id")
    enders = enders.unionAll(turnless.select(none, none, zero, zero, "conv_id"))
    ends = stage.put(ends_of(enders), "ends")
    distinct = segments.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.count_if("last").alias("n_ends")
    )
    shown = segments.select(F.col("conv_id").alias("low"), "k", "h1", "h2", "turns")
    rows = distinct.join(shown, ["low", "k"]).join(ends, KEY, "left")
    blocks = with_borders(write_blocks(rows, stage, block_turns), stage)
    firsts = stage.put(first_rows(blocks, segment), "first")
    later = beyond(segments, firsts)
    nodes = forests(blocks.join(later, "block", "left"), segment)
    empty = turnless.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")).where("n > 0")
    fields = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in NODES.split(", ")}
    fields |= {c: zero for c in ("depth", "p1", "p2", "children", "leaves", "w", "fresh")}
    fields |= {"block": F.lit(-1).cast("bigint"), "part": F.lit(True)}
    row = lambda df, **own: df.select(*[c.alias(name) for name, c in (fields | own).items()])
    nodes = nodes.unionAll(row(empty, n=F.col("n"), low=F.col("low")))
    nodes = nodes.unionAll(row(ends.where("size = 0"), n=zero, ends=F.col("ends")))
    found = merged(stage.put(nodes, "nodes"))
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.col("parent_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),  # a lone root is a leaf
        (F.col("w") - F.col("fresh")).alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.lit(nothing)).alias("ends_sha256"),
    )



"""The conversation trie beside brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from keyloom.llm import prefix_trie

COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, depth string, n int"


def brute(rows):
    """Nodes as tuples in the order of COLUMNS; rows have no two turns with one number."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(
        (r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)
    ):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, cs in members.items():
        cost = (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += cost
            leaves[path[:d]] += not children[path]
    out = []
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        out.append(
            (
                min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children[path],
                leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(df, **options).select(COLUMNS).collect()), key=str)


def some_rows(seed, n_convs, longest, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(2 * n_convs), n_convs):
        turns = [(r.choice(["user", None, ""]), r.choice([*words, None])) for _ in range(r.randint(1, longest))]
        rows += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rows = some_rows(seed, [12, 60, 120, 40][seed], [3, 6, 12, 30][seed], ["a", "é", "same " * 9][: 1 + seed % 3])
    for options in ({}, {"segment": 3, "block_turns": 7}, {"segment": 1, "block_turns": 2}):
        assert found(spark, rows, **options) == brute(rows), options


def test_copies_and_long_conversations(spark):
    long = [(c, i, "user", f"t{i % 7}") for c in (0, 1, 40, 41) for i in range(300 + c)]
    copies = [(100 + 5 * c, i, "user", "hello" * (i + 1)) for c in range(200) for i in range(4)]
    rows = long + copies + [(None, 0, "user", "orphan"), (7, 1, "user", "x" * 200_000), (8, None, None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, segment=16, block_turns=50) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    # The origin of conversation c is absent and c has fewer turns than it would take.
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_turns_with_one_number_are_kept(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "b")]
    nodes = found(spark, rows)
    assert sorted(n[1] for n in nodes) == [0, 1, 2, 3]

"""Best-fit packing beside the tokenizers library and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyloom.llm import packing
from keyloom.staging import Stage

PATH = public_tokenizers.path("byte_bpe_50k.json")
# Extra columns have names that the operator uses itself.
SCHEMA = "doc_id bigint, text string, split string, number int, ids string, length string, offset int"
SENTENCE = "The quick brown fox jumps over the lazy dog, and runs away into the dark wood.\n"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\r "), (4, SENTENCE), (5, SENTENCE), (5, SENTENCE), (5, SENTENCE * 3),
    (None, "orphan"), (None, None), (6, "ÉCOLE été 'straße' 你好 🙂 can't 'LL"), (7, "x" * 50_000),
    (8, "a <|endoftext|> b<|endoftext|>"), (9, SENTENCE * 700), (10, "\x00\x85  ﻿\x1c"),
    *[(100 + i, SENTENCE * (i % 60)) for i in range(300)],
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "x", "y", 2) for i, t in texts], SCHEMA)


def check_packed(rows, capacity):
    """Sequences without gaps, and every document whole in its pieces."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def expected(texts, capacity):
    library = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return Counter(out)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(spark, capacity):
    rows = packing.digest(frame(spark, TEXTS), PATH, capacity).collect()
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert found == expected(TEXTS, capacity)
    n = check_packed(rows, capacity)
    assert n <= 1.03 * sum(r.length for r in rows) / capacity + 1


def test_sequences_hold_the_ids(spark):
    pieces = packing.write_pieces(frame(spark, TEXTS), Stage(spark), PATH, 256)
    placed = packing.place(pieces, 256)
    sequences = packing.sequences(placed).collect()
    found = Counter()
    for s in sequences:
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == sum(d.length for d in s.documents) <= 256
        for d in s.documents:
            part = ids[d.offset : d.offset + d.length]
            found[(d.doc_id, d.piece, d.start, d.length, zlib.crc32(part.tobytes()))] += 1
    assert found == expected(TEXTS, 256)


def test_empty(spark):
    assert packing.digest(frame(spark, []), PATH).count() == 0


def bins_by_brute_force(lengths, capacity):
    """Fewest sequences, by trying all places of every item."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                put(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 30, 2048])
    counts = {r.randint(1, capacity): r.randint(1, 2) for _ in range(r.randint(1, 6))}
    lengths = sorted((k for k, n in counts.items() for _ in range(n)), reverse=True)
    plan = packing.plan(counts, capacity)
    length = np.array(lengths)
    number = np.concatenate([np.arange(counts[k]) for k in sorted(counts, reverse=True)])
    sequence, offset = plan.place(length, number)
    spans = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths):
        spans[s].append((o, n))
    assert len(spans) == plan.n_sequences
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    assert plan.n_sequences <= 1.25 * bins_by_brute_force(lengths, capacity)


def test_matching_of_large_items_is_largest():
    r = random.Random(3)
    for _ in range(50):
        lengths = sorted(r.randint(11, 30) for _ in range(9))  # of 30: all above a third
        pairs = len(lengths) - packing.plan(Counter(lengths), 30).n_sequences
        fewest = bins_by_brute_force(lengths[::-1], 30)
        assert len(lengths) - pairs == fewest


def test_counts_do_not_slow_the_plan():
    counts = {k: 10**9 + k for k in range(1, 2049)}
    plan = packing.plan(counts)
    total = sum(k * n for k, n in counts.items())
    assert plan.n_sequences <= 1.01 * total / 2048
    assert len(plan.entries) < 50_000

"""Suffix dedup: what a task holds, and hot anchors, which small tables do not have."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from keyloom.llm import blocks as B
from keyloom.llm import suffix_dedup as S
from keyloom.staging import Stage

WORDS = "able bark cord dusk etch fawn gulf hive iris jolt kelp lynx".split()


def marks_by_hand(contexts):
    """A bit per string of (block, id, text): whether a smaller id has it."""
    least = {}
    for _, i, text in contexts:
        for a in range(len(text) - 49):
            least[text[a : a + 50]] = min(least.get(text[a : a + 50], i), i)
    return [i > least[text[a : a + 50]] for _, i, text in contexts for a in range(len(text) - 49)]


def test_a_shard_is_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    families = rng.integers(97, 123, (400, 90)).astype(np.uint8)
    part = np.sort(rng.integers(0, 256, 400))
    contexts, rows = [], []
    for block in range(3):
        own = np.sort(rng.permutation(400)[:300])
        ids = rng.integers(0, 6, 300)
        texts = [families[f, : rng.integers(50, 91)].tobytes() for f in own]
        contexts += [(block, int(i), t) for i, t in zip(ids, texts)]
        rows.append(
            {
                "shard": 0,
                "block": block,
                "ids": ids.astype("<i8").tobytes(),
                "sizes": np.array([len(t) - 49 for t in texts], "<i4").tobytes(),
                "parts": part[own].astype(np.uint8).tobytes(),
                "body": zstandard.compress(b"".join(texts)),
            }
        )
    lengths = []

    def order(s, sort=S.suffix_order):
        lengths.append(len(s))
        return sort(s)

    monkeypatch.setattr(S, "suffix_order", order)
    monkeypatch.setattr(S, "PART_BYTES", 5_000, raising=False)
    found = S._mark(pa.Table.from_pylist(rows)).to_pylist()
    bits = []
    for row in found:
        n = sum(len(t) - 49 for b, _, t in contexts if b == row["block"])
        bits += np.unpackbits(np.frombuffer(row["answers"], np.uint8), count=n).astype(bool).tolist()
    assert bits == marks_by_hand(contexts)
    assert max(lengths) < 7_000  # 63 KB come in


def test_a_stage_has_one_python_worker_a_core(spark):
    docs = spark.createDataFrame([(1, "a" * 60)], "doc_id bigint, text string")
    asked = S._ask_anchors(B.write_blocks(docs, Stage(spark)), 4)
    assert asked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("hot, part_bytes", [(1, 100), (1, 10**6), (3, 2_000), (10**6, 100)])
def test_hot_anchors_and_parts(monkeypatch, hot, part_bytes):
    """The steps of op1 on two blocks and three shards, beside brute force."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(2)
    passages = [" ".join(rng.choice(WORDS, 30)) for _ in range(4)]
    texts = [
        " ".join([*rng.choice(WORDS, 15), passages[rng.integers(4)], *rng.choice(WORDS, 15)])
        for _ in range(40)
    ]
    ids = [None if k % 13 == 5 else int(k) // 2 for k in rng.permutation(40)]
    n_shards, rows = 3, []
    for block in range(2):
        own = [t.encode() for t in texts[block * 20 : block * 20 + 20]]
        rows.append(
            {
                "block": block,
                "doc_id": ids[block * 20 : block * 20 + 20],
                "ends": np.cumsum([len(t) for t in own]).astype("<i8").tobytes(),
                "body": zstandard.compress(b"".join(own)),
                "kinds": [],
                "marks": [],
            }
        )
    asked = []
    for row in rows:
        keys, n = S._anchor_keys(row)
        for s in range(n_shards):
            k = B.shard_of(keys, n_shards) == s
            asked.append(
                {"shard": s, "block": row["block"], "keys": keys[k].astype("<u4").tobytes(), "info": n[k].tobytes()}
            )
    for s in range(n_shards):
        group = pa.Table.from_pylist([x for x in asked if x["shard"] == s])
        for x in S._count_documents(group).to_pylist():
            rows[x["block"]]["kinds"].append(x)
    sent = []
    for row in rows:
        row |= dict(zip(S.PIECES, S._packed(S._pieces_of(row, n_shards))))
        sent += S._messages(row, n_shards).to_pylist()
    for s in range(n_shards):
        for x in S._mark(pa.Table.from_pylist([x for x in sent if x["shard"] == s])).to_pylist():
            rows[x["block"]]["marks"].append(x)

    known = [S.NO_ID if i is None else i for i in ids]
    least = {}
    for i, t in zip(known, texts):
        for a in range(len(t) - 49):
            least[t[a : a + 50]] = min(least.get(t[a : a + 50], i), i)
    for row in rows:
        expected = []
        for k in range(row["block"] * 20, row["block"] * 20 + 20):
            gone = np.zeros(len(texts[k]), bool)
            for a in range(len(gone) - 49):
                gone[a : a + 50] |= known[k] > least[texts[k][a : a + 50]]
            expected.append(gone)
        n_bytes = sum(map(len, expected))
        assert S._gone(row, n_bytes, n_shards).tolist() == np.concatenate(expected).tolist()

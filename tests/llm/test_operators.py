"""The operators beside brute force, on small tables with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from html import escape

import numpy as np
import pytest

import corpus_pipeline
from keyloom.llm import decontaminate, html_text, licenses, line_dedup, mixing, near_dedup
from keyloom.llm import quality, queries, suffix_dedup, token_counts, token_store
from keyloom.llm.suffix_array import suffix_order
from keyloom.llm.wavelet import WaveletMatrix
from keyloom.staging import Stage
from tests.check_queries import compare, duck

SF_DIR = "/root/testdata/sf0.001"
# Extra columns have names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, w int, shard int"
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away into the dark wood today "


def rows_of(texts):
    """(doc_id, text) with nulls in the other columns of some rows."""
    langs, sources = ["en", None, "de", "xx"], ["b", None, "a"]
    return [
        (i, t, langs[k % 4], sources[k % 3], None, "x", 1, 2) for k, (i, t) in enumerate(texts)
    ]


AWKWARD = rows_of(
    [
        (1, None),
        (2, ""),
        (3, " \t\n\r "),
        (4, SENTENCE * 3),
        (5, SENTENCE * 3),
        (5, SENTENCE * 3),
        (6, SENTENCE.upper() + "ÉCOLE été straße"),
        (7, "word"),
        (None, SENTENCE + "orphan"),
        (8, "x" * 300_000),
        (9, "a|b # $ 10.5 <|endoftext|> it's\n\nSame line\n same LINE \n"),
        (10, SENTENCE * 2000),
    ]
)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    text = "Fox jumps OVER the lazy dog and runs away into the dark"
    listed = [("i1", text), ("i1", text), (None, "away into"), ("i3", None), ("i4", "")]
    return spark.createDataFrame(listed, "item_id string, text string")


SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_against_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF_DIR), duck(SF_DIR), SQL[name]) == ""


def brute_suffix(rows):
    out, seen = [], {}
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for key in dict.fromkeys(r[0] for r in by_id):
        own = [(r[1] or "").encode() for r in by_id if r[0] == key]
        for b in own:
            gone = bytearray(len(b))
            for i in range(len(b) - 49):
                if b[i : i + 50] in seen:
                    gone[i : i + 50] = b"\1" * 50
            left = bytes(c for c, g in zip(b, gone) if not g)
            spans = len(re.findall(rb"\x01+", bytes(gone)))
            out.append((key, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
        for b in own:
            seen.update((b[i : i + 50], 1) for i in range(len(b) - 49))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, 5000])
def test_suffix_dedup(awkward, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = [tuple(r) for r in suffix_dedup.digest(awkward, 5_000).collect()]
    assert sorted(got, key=repr) == brute_suffix(AWKWARD)
    assert suffix_dedup.digest(empty).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n in range(80):
        s = rng.integers(1, 1 + rng.integers(1, 4), n).astype(np.int64)
        assert suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_decontaminate(awkward, empty, items):
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.digest(awkward, items).collect()}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", SENTENCE)
    assert rows[(4, 3 * len(words))].n_hit == 3 * 12 and rows[(4, 3 * len(words))].n_items == 2
    assert not rows[(1, 0)].contaminated and rows[(7, 1)].n_hit == 0
    assert rows[(4, 3 * len(words))].items_sha256 == hashlib.sha256(b",i1").hexdigest()
    # Blocks of the query set give the same rows.
    small = decontaminate.contamination(awkward, items, block_shingles=2)
    key = lambda r: repr(tuple(r))
    whole = decontaminate.contamination(awkward, items)
    assert sorted(map(key, small.collect())) == sorted(map(key, whole.collect()))
    assert decontaminate.digest(empty, items).collect() == []
    assert decontaminate.clean(awkward, items.limit(0)).count() == len(AWKWARD)
    assert decontaminate.clean(awkward, items).columns == awkward.columns


def test_quality(awkward, empty):
    rows = {r.doc_id: r for r in quality.judge(awkward).collect()}
    assert len(rows) == len({r[0] for r in AWKWARD}) and rows[1].n_words == 0 and not rows[1].kept
    assert rows[4].n_repeat_words == rows[4].n_words and rows[4].base_failed
    assert rows[8].word_chars == 300_000 and rows[9].n_symbols == 7 and rows[9].n_dup_lines == 0
    assert quality.judge(empty).collect() == []
    assert quality.keep(awkward).columns == awkward.columns


def test_token_files(awkward, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    plain = Tokenizer.from_file(path)
    rows = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    ids = [plain.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    shards = token_store.write_shards(awkward, Stage(awkward.sparkSession), path, shard_bytes=50_000, shard_ids=900)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(shards).collect())
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    want = [(s, r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, r, i in zip(starts, rows, ids)]
    assert got == sorted(want)
    token = ids[-1][0]
    counted = token_store.token_counts(shards, [token]).first().n
    assert counted == sum(i.count(token) for i in ids)
    plain.encode_special_tokens = True
    sizes = sorted(((r[0] is not None, r[0] or 0), len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    found = token_counts.counts(awkward, path, file_bytes=50_000, block_ids=64).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens) for r in found) == sizes
    assert token_store.read_documents(token_store.write_shards(empty, Stage(empty.sparkSession), path)).collect() == []
    assert token_counts.counts(empty, path).collect() == []


def test_separator_scan_over_blocks(spark):
    flat = [5, 9, 5, 5, 9, 9, 5, 5, 5, 5, 5, 9, 5]
    for size in (1, 2, 5, 20):
        cut = [(0, k // size, np.array(flat[k : k + size], "<u4").tobytes()) for k in range(0, len(flat), size)]
        files = spark.createDataFrame([(f, b, bytearray(x)) for f, b, x in cut], "file bigint, block bigint, ids binary")
        got = sorted((r.number, r.start, r.n_tokens, r.closed) for r in token_counts.scan(files, 9).collect())
        assert got == [(0, 0, 2, True), (1, 2, 3, True), (2, 5, 1, True), (3, 6, 6, True), (4, 12, 1, False)]


def test_separator_scan_over_runs_of_blocks(spark, monkeypatch):
    # Token files have small rows; end ids stand at both sides of a run's border, and one block is empty.
    from keyloom.staging import Stage

    docs = spark.createDataFrame([(1, "some words of a text " * 4_000)], "doc_id bigint, text string")
    written = token_counts.write_files(docs, Stage(spark), queries.vocabulary())[0]
    assert max(len(r.ids) for r in written.collect()) <= 4_096
    monkeypatch.setattr(token_counts, "RUN_IDS", 6)
    ids = np.full(53, 5, "<u4")
    ends = [0, 7, 8, 9, 30, 50]
    ids[ends] = 9
    cut = [(0, k, bytearray(x.tobytes())) for k, x in enumerate(np.split(ids, [2, 8, 8, 9, 11, 20, 40]))]
    for parts in (1, 3):
        files = spark.createDataFrame([*cut, (1, 0, bytearray())], "file bigint, block bigint, ids binary").coalesce(parts)
        got = sorted((r.file, r.start, r.n_tokens, r.closed) for r in token_counts.scan(files, 9).collect())
        marks = [*ends, len(ids) - 1]
        assert got == [(0, a + 1, b - a, b != marks[-1]) for a, b in zip([-1, *marks], marks)]


def test_table_of_chunks_is_bounded_in_bytes():
    from keyloom.llm import encoder

    coder = encoder.Encoder(queries.vocabulary(), True, 2_000_000)
    for k in range(30):
        coder.encode([b" ".join(b"%d%s" % (100 * k + i, b"x" * 1_000) for i in range(100))], 1)
        assert sum(map(len, coder.numbers)) < 2_300_000


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 70_000, 3_001).astype(np.uint32)
    ids[::7] = 5
    matrix = WaveletMatrix.loads(len(ids), WaveletMatrix.build(ids).dumps())
    spots = np.arange(0, len(ids), 13)
    assert (matrix.decode() == ids).all() and (matrix.access(spots) == ids[spots]).all()
    for token in (5, int(ids[3]), 69_999, 200_000):
        assert matrix.count(token) == (ids == token).sum()
        assert (matrix.occurrences(token) == np.flatnonzero(ids == token)).all()


def test_html(spark):
    page = (
        "<html><head><title>t</title></head><body><header>top</header><nav><a href=x>home</a></nav>"
        "<article><h1>Head</h1><p>One &amp; two<br>three<p>short</p><div class='ad'>buy</div>"
        "<script>var a='</p>'</script><section id=comments><p>nice</p></section></article>"
        "<aside>side</aside><form>x</form><footer>&copy; end</footer>"
    )
    rows = [(1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<nav><a>x"), (1, "u", page)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [tuple(r) for r in html_text.extract(frame).collect()]
    text = "Head\nOne & two three\nshort"
    assert got == [(1, "u", text, len(text)), (None, None, "", 0), (2, "u", "", 0), (3, "u", "", 0), (1, "u", text, len(text))]
    assert html_text.extract(frame.limit(0)).collect() == []


def paragraphs(path):
    return [" ".join(p.split()) for p in open(path).read().split("\n\n") if len(" ".join(p.split())) >= 70]


@pytest.mark.parametrize("shell", ["<body>{}", "<body><div><a href=x>Home</a></div>{}<div><a href=y>Next page</a></div>"])
def test_html_without_article(shell):
    def kept(texts):
        page = shell.format("".join(f"<p>{t if '<a href' in t else escape(t)}</p>" for t in texts))
        return html_text.main_text(page).split("\n")

    text = paragraphs("/usr/share/common-licenses/GPL-3")
    assert len(text) > 90 and kept(text) == text
    chinese = "这是一个没有文章标记的网页，它的段落很长，但是没有任何一个已知语言的常用词，所以必须由长度和链接来决定。"
    czech = "Každý odstavec této stránky je dlouhý a neobsahuje žádné odkazy, přesto v něm nejsou slova známých jazyků. "
    for own in ([chinese] * 3, [chinese], [czech * 3, czech.strip()] * 2, [czech.strip()]):
        assert kept([t.strip() for t in own]) == [t.strip() for t in own]
    # Lists of links stay out, with text in any language around them.
    links = "".join(f"<a href=x{i}>some headline of the day</a> " for i in range(9))
    for own in ([t for t in text if len(t) > 200], [czech * 3] * 3):
        own = [t.strip() for t in own]
        assert kept([own[0], links, *own[1:]]) == own


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><article>{}</article><div class=sidebar><p>side</p></div></div>",
        "<div class='layout sidebar'><article>{}</article></div>",
        "<div id='page' class='no-sidebar'><main>{}</main></div>",
        "<div class='noticeboard comments'><div role=main>{}<div class=ad>buy</div></div></div>",
        "<article class='post category-notices tag-ads'>{}</article>",
        "<article class='comments'>{}</article>",
        "<div class='sidebar-wrapper'>{}</div><div class=ad>buy</div>",
        "<section id='discussion'>{}</section>",
        "<article><div id='related-work'>{}</div><div class=related><a href=x>More of this</a></div></article>",
        "<div class='elementor-widget'>{}</div><div class=widget><a href=x>Last posts</a></div>",
        "<div class=layoutHasSidebar><article>{}<ol class=comments><article>nice</article></ol></article></div>",
        "<div class=sidebar-layout><article>{}</article><div id=comments><article class=comment>nice</article></div></div>",
        "<article>{}</article><article class=sponsored>Buy this</article>",
    ],
)
def test_html_names(page):
    text = paragraphs("/usr/share/common-licenses/GPL-3")[1:20]
    html = page.format("".join(f"<p>{escape(t)}</p>" for t in text))
    assert html_text.main_text(f"<html><body>{html}</body></html>").split("\n") == text


def test_html_name_of_a_part():
    text = paragraphs("/usr/share/common-licenses/GPL-3")[1:20]
    parts = [f"<section id=discussion><p>{text[0]}</p></section>", f"<div id=related-work><p>{text[1]}</p></div>"]
    page = "<body>" + "".join(f"<p>{t}</p>" for t in text[2:]) + "".join(parts) + "<div class=comments><p>{}</p></div>"
    assert html_text.main_text(page.format(text[3])).split("\n") == text[2:] + text[:2]


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * w[s] / weight for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mixing(spark, awkward, empty):
    rng = np.random.default_rng(5)
    rows = [
        (i, "w " * int(rng.integers(0, 60)), "en", [None, "a", "b", "tiny"][min(int(k), 3)], None, "x", 1, 2)
        for i, k in enumerate(rng.choice(4, 3000, p=[0.3, 0.4, 0.29, 0.01]))
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    options = {"block_words": 500, "shard_blocks": 16}
    got = mixing.taken(frame, **options).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        source = by_id[r.doc_id]
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert r.taken <= 3 * r.size
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for source in sizes:
        assert abs(target[source] - want[source]) < 1e-6 * want[source] + 1e-6
        assert abs(taken[source] - want[source]) <= 60
    again = mixing.taken(frame, **options).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mix = mixing.mixed(frame, **options)
    assert mix.count() == mixing.draws(frame, **options)[1].count()
    assert len(mixing.taken(awkward).collect()) == len(AWKWARD)
    assert mixing.shuffled(awkward).columns == awkward.columns
    assert mixing.taken(empty).collect() == []


def test_hypergeometric_split():
    have = np.array([10, 0, 25, 5])
    for seed in range(50):
        left = mixing.split_counts(np.random.default_rng(seed), have, 17)
        assert left.sum() == 17 and (left >= 0).all() and (left <= have).all()


def brute_groups(rows, size=4, percent=80):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_dedup(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "SLICE_BITS", 1)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts = []
    for group in range(12):
        base = rng.choice(vocabulary, 90).tolist()
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for k in rng.choice(90, int(rng.integers(0, 6)), replace=False):
                copy[k] = "changed"
            texts.append((len(texts), " ".join(copy)))
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = brute_groups(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(frame).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert near_dedup.dedup(frame).count() == len({c for _, c in want.values()})
    rows = near_dedup.groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.component_id for r in rows if r.doc_id in (4, 5, 10)} == {4}
    assert all(r.kept for r in rows if r.doc_id in (None, 1, 2, 3, 7))
    assert near_dedup.groups(empty).collect() == []


def test_near_dedup_reach():
    rng = np.random.default_rng(6)
    assert near_dedup.REACH < 2 * len(near_dedup.chunk_ends())
    for _ in range(200):
        a = rng.integers(0, 2**16, near_dedup.MINIMA).astype(np.uint16)
        b = a.copy()
        # 27 errors in the worst places: two in a chunk, as far as they go
        spots = [rng.choice(np.arange(lo, hi), 2, replace=False) for lo, hi in near_dedup.chunk_ends()]
        first = list(np.concatenate(rng.permutation(spots)))
        rest = list(rng.permutation(np.setdiff1d(np.arange(near_dedup.MINIMA), first)))
        b[(first + rest)[:27]] += 1
        own = near_dedup._entries([a.tobytes(), b.tobytes()])
        assert set(own[0].tolist()) & set(own[1].tolist())


def test_licenses(spark, empty):
    texts = [(1, "first words here\nReleased under the MIT License.\nand others follow"), (2, "licensed under the apache license version 2 0"), (3, None), (4, "MIT")]
    got = {r.doc_id: (r.n_lines, r.n_matches, r.licenses) for r in licenses.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got == {1: (3, 1, "MIT"), 2: (1, 1, "Apache-2.0"), 3: (1, 0, ""), 4: (1, 0, "")}
    assert licenses.scan(empty).collect() == []


def test_licenses_wrapped_and_embedded(spark):
    words = [f"word{i}" for i in range(3000)]
    before, after = " ".join(words[:1500]), "\n".join(words[1500:])
    notices = {name: list(texts) for name, texts in licenses.TEMPLATES.items()}
    texts, want = [], {}
    for name, own in licenses.with_full_texts(notices).items():
        for text in own:
            cut = text.split()
            wrapped = "\n".join(" * " + " ".join(cut[k : k + 9]) for k in range(0, len(cut), 9))
            texts.append((len(texts), f"{before}\n{wrapped}\n{after}"))  # a header in a long document
            want[len(texts) - 1] = (1, name)
            texts.append((len(texts), f"{before} {' '.join(cut)} {before}"))  # inside a line
            want[len(texts) - 1] = (0, name)
    texts.append((9000, "Copyright 2020 X. Licensed under CC BY 4.0."))
    texts.append((9001, f"{before} {licenses.TEMPLATES['MIT'][2]} x {licenses.TEMPLATES['ISC'][0]}\n" * 2))
    texts.append((9002, "Permission is hereby granted\nunder the terms of the software\n" + before))
    want.update({9000: (0, "CC-BY-4.0"), 9001: (0, "ISC,MIT"), 9002: (None, "")})
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.n_matches, r.licenses) for r in licenses.scan(frame).collect()}
    for i, (line, names) in want.items():
        assert set(names.split(",")) <= set(got[i][1].split(",")), (i, got[i], names)
    assert got[9000] == (1, "CC-BY-4.0") and got[9001] == (2, "ISC,MIT") and got[9002] == (0, "")
    spots = {(r.doc_id, r.license): r.dice for r in licenses.matches(frame).collect() if r.unit == want[r.doc_id][0]}
    assert all(spots[i, name] >= 0.99 for i, (line, names) in want.items() if names for name in names.split(","))


def test_line_dedup(spark, awkward, empty):
    texts = [(i, f" Common Line \nown {i}\n\ncommon line") for i in range(12)]
    rows = line_dedup.digest(spark.createDataFrame(rows_of(texts), SCHEMA), block_bytes=60).collect()
    for r in rows:
        left = hashlib.sha256(f"own {r.doc_id}\n".encode()).hexdigest()
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (4, 2, left)
    assert len(line_dedup.digest(awkward).collect()) == len(AWKWARD)
    assert line_dedup.digest(empty).collect() == []
    keys = np.unique(np.random.default_rng(4).integers(1, 2**63, 5000).astype(np.uint64))
    assert sorted(line_dedup.PerfectHash.build(keys).places(keys).tolist()) == list(range(len(keys)))


def test_pipeline(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    rooms = brute_groups([(i, before[i].text) for i in kept], size=5)
    single = {i for i, (_, c) in rooms.items() if i == c}
    dirty = {r.doc_id for r in queries.op2_decontaminate(spark, SF_DIR).collect() if r.contaminated}
    left = single - dirty
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} <= left
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", before[i].text)) for i in left}
    drawn = sum(size[r.doc_id] for r in rows)
    assert abs(drawn - sum(size.values())) < 0.1 * sum(size.values())
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_pipeline_on_awkward_rows(spark, empty):
    """Columns with the names that the operators use, nulls, repeated rows and long texts; no rows."""
    words = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(rng.choice(words, 80)) + ". The end of the day and of the world.") for i in range(30)]
    texts += [(30, texts[0][1]), (31, None), (None, texts[5][1]), (7, texts[7][1]), (32, ""), (33, texts[9][1] * 300)]
    schema = SCHEMA + ", _id int, _hash string, place bigint, epoch int, row string, mark int, digest string"
    docs = spark.createDataFrame([(*r, 9, "h", 9, 9, "r", 9, "d") for r in rows_of(texts)], schema)
    for start in (docs, docs.limit(0)):
        now = Stage(spark).put(start, "docs")
        for _, step in corpus_pipeline.STAGES[:-1]:
            now = Stage(spark).put(step(spark, now, SF_DIR), "docs")
            assert now.columns == docs.columns
            assert {(r._id, r._hash, r.place, r.epoch, r.shard, r.row) for r in now.collect()} <= {(9, "h", 9, 9, 2, "r")}
        left = now.select("doc_id").collect()
        rows = corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in left)
        assert bool(left) == (start is docs)


def test_shuffled_token_shards(spark):
    docs = spark.createDataFrame([(i // 3, f"text {i // 3}") for i in range(300)], "doc_id bigint, text string")
    docs = Stage(spark).put(docs.repartition(3), "docs")
    path = queries.vocabulary()
    shards = token_store.write_shards(docs, Stage(spark), path, shard_bytes=500, order=token_store.shuffle_order())
    rows = sorted(token_store.read_documents(shards).collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert sum(a.doc_id == b.doc_id for a, b in zip(rows, rows[1:])) < 20
    ordered = token_store.read_documents(token_store.write_shards(docs, Stage(spark), path)).collect()
    assert {(r.doc_id, r.ids_crc32) for r in rows} == {(r.doc_id, r.ids_crc32) for r in ordered}


def test_html_unquoted_addresses():
    text = html_text.main_text
    page = "<div class=sidebar><a href=http://x.org/>Menu one</a> <a href=/b/>two</a></div><article><p>{}</p></article>"
    long = "The words of the article are many and they are here for all to read and to see. " * 3
    assert text(page.format(long)) == text(page.replace("=http://x.org/", '="http://x.org/"').replace("=/b/", '="/b/"').format(long)) == long.strip()


@pytest.mark.parametrize("good,bad,sample", [(5, 7, 6), (40, 3, 20), (1, 90, 45), (60, 60, 1), (30, 50, 80)])
def test_large_draws_follow_the_exact_law(good, bad, sample):
    """Equal steps of the random number give every count its share of all choices."""
    law = [math.comb(good, k) * math.comb(bad, sample - k) if k <= sample else 0 for k in range(good + 1)]
    n = 20_000
    drawn = [mixing._by_inversion((i + 0.5) / n, good, bad, sample) for i in range(n)]
    for k, ways in enumerate(law):
        assert abs(drawn.count(k) - n * ways / math.comb(good + bad, sample)) <= 1.01


def test_draws_beyond_the_generators_limit():
    rng = np.random.default_rng(1)
    good, bad, sample = 3_000_000_000, 1_500_000_000, 2_250_000_000
    drawn = np.array([mixing._hypergeometric(rng, good, bad, sample) for _ in range(200)])
    spread = (sample * (2 / 3) * (1 / 3) / 2) ** 0.5
    assert abs(drawn.mean() - 1.5e9) < 5 * spread / 200**0.5 and 0.8 < drawn.std() / spread < 1.2
    assert mixing._hypergeometric(rng, good, 0, sample) == sample
    assert mixing._hypergeometric(rng, 2, 4_000_000_000, 4_000_000_002) == 2
    left = mixing.split_counts(rng, np.array([good, 7, bad]), sample)
    assert left.sum() == sample and (left <= [good, 7, bad]).all()

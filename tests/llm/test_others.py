"""Operators over vectors, pages and conversations, and the pipeline."""

import os
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splinebrook.llm import ann, chat_format, embed_dedup, html_extract, queries, simhash

from .test_documents import slow_components


def vectors(spark, x, odd=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(odd)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


ODD = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0, 2.0])]


def clustered(seed=0, n=260, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[40:80] = x[:40] + 0.2 * rng.standard_normal((40, d))
    x[80:100] = x[5]
    x[100:140] = x[7] + 0.3 * rng.standard_normal((40, d))
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("tile", [32, 8192])
def test_embedding_links(spark, tile):
    x = clustered()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    comp = slow_components(len(x), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, x, ODD), tile=tile).collect()}
    assert len(got) == len(x) + len(ODD)
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == comp
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k, _ in ODD)


def test_embedding_ids_that_are_null_or_repeated(spark):
    v, w = [1.0] * 16, [1.0, -1.0] * 8
    rows = [(1, v), (None, v), (None, w), (3, w), (3, w), (None, [0.0] * 16), (None, None), (9, [2.0] * 16)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, node long, place int")
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (None, 2, 1, False), (9, 2, 1, False), (None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, False), (None, 0, None, False)], key=str)


def test_a_tile_that_links_throughout_takes_bounded_memory():
    """8192 near vectors have 33 million links: they are counted and joined a strip at a time."""
    code = (
        "import resource, numpy as np\n"
        "from splinebrook.llm import embed_dedup as e\n"
        "x = 1 + 0.1 * np.random.default_rng(0).standard_normal((8192, 64))\n"
        "t = e.Tile(np.arange(8192), np.ones(8192, dtype=int), x)\n"
        "nodes, links, roots = t.links(t, np.eye(64), 0.9)\n"
        "assert (links == 8191).all() and (roots == 0).all()\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)\n"
    )
    root = str(Path(corpus_pipeline.__file__).parent)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, env=os.environ | {"PYTHONPATH": root})
    assert int(out.stdout.split()[-1]) < 1_000_000


def test_tiles_that_come_close():
    rng = np.random.default_rng(0)
    heads = rng.uniform(0.02, 1, (500, 8)) * rng.choice([-1, 1], (500, 8))
    places = embed_dedup.curve(heads)
    assert len(set(places.tolist())) > 490 and (embed_dedup.curve(np.sign(heads)) >> 48 == embed_dedup.curve(heads) >> 48).all()


def exact(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


def test_neighbours_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    vector = F.col("embedding").cast("array<double>").alias("vector")
    index = ann.grow(spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), vector), x.shape[1], len(x), ann.PARTS, ann.LEAF, 10, ann.SAMPLE, ann.SEED)
    assert len(index.routers) == 1 and len(set(index.homes(x).tolist())) == ann.PARTS  # small tables are partitioned too
    got = queries.op2_ann(spark, sf).orderBy("query_id", "rank").collect()
    hits = total = 0
    for q in range(0, len(x), 100):
        want, d = exact(x, q, 10)
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in own)
        hits, total = hits + len({r["vec_id"] for r in own} & set(want.tolist())), total + 10
    assert hits / total >= 0.9


@pytest.mark.parametrize(("parts", "leaf"), [(16, 1000), (4, 120)])
def test_neighbours_recall_in_parts(spark, parts, leaf):
    """One level of routers, and several; a third of the rows are one vector, which no router can cut."""
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((12, 16))[rng.integers(0, 12, 3000)] * 2 + rng.standard_normal((3000, 16))).astype(np.float32).astype(float)
    for rows in (x, np.vstack([x, np.repeat(x[:1] + 9, 1500, axis=0)])):
        df = vectors(spark, rows).withColumn("node", F.lit(1)).withColumn("query", F.lit(0))
        index = ann.grow(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), 16, len(rows), parts, leaf, 10, 4096, 1)
        nodes = index.homes(rows)
        assert len(index.routers) > (1 if parts == 4 else 0) and max(np.bincount(nodes[:3000])) <= 2 * leaf
        got = ann.search(df, F.col("vec_id") % 100 == 0, parts=parts, leaf=leaf).collect()
        asked = range(0, len(rows), 100)
        hits = 0
        for q in asked:
            want, d = exact(rows, q, 10)
            own = [r for r in got if r["query_id"] == q]
            assert len(own) == 10 and all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-9) for r in own)
            hits += sum(r["score"] <= d[want[-1]] + 1e-12 for r in own)
        assert hits / (10 * len(asked)) >= 0.9


def test_neighbours_without_structure(spark):
    """Noise in many dimensions: no leaf is much better than another, so many are visited and recall holds."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (6000, 48)).astype(np.float32).astype(float)
    got = ann.search(vectors(spark, x), F.col("vec_id") % 100 == 0, parts=16, leaf=100).collect()
    hits = 0
    for q in range(0, 6000, 100):
        want, _ = exact(x, q, 10)
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(want.tolist()))
    assert hits / 600 >= 0.9


def test_neighbours_odd(spark):
    x = np.ones((4, 16))
    got = ann.search(vectors(spark, x, ODD), F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (2, 0, 0), (2, 1, 0), (2, 3, 0)]
    assert ann.search(vectors(spark, [], ODD), F.lit(True)).count() == 0
    assert embed_dedup.near_duplicates(vectors(spark, [], ODD[:2])).count() == 2


def test_parts_are_balanced():
    x = clustered(1)
    labels = ann.balanced_parts(ann.neighbour_lists(x, 10), 4, np.random.default_rng(0))
    assert np.bincount(labels).tolist() == [65] * 4


PAGES = [
    ("<nav><a>x</a></nav><article><h1>T &amp; U</h1><p>one  two\n three<p>four<br>five</article><footer>f</footer>", "T & U\none two three\nfour\nfive"),
    ('<div class="menu">m</div><p>Short.</p><p>A long line of text here</p><div class="ad">buy</div><p>More text</p><section id="comments"><p>nice</p></section>', "Short.\nA long line of text here\nMore text"),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><p>a<b>b</b>&#33;</p>", "ab!"),
    ("plain text", "plain text"),
    ('<div class="with-sidebar"><p>kept</p><aside>gone</aside></div>', "kept"),
    ("<main><p>in</p></main><p>out, and much longer than what is in</p>", "in"),
    ("", ""),
    (None, ""),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<p>a < b</p><!-- <p>no</p> -->", "a < b"),
    ("<form><input><p>f</p></form>", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(k, None, h, 1, 2) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int, n_chars int")
    got = html_extract.extract(df).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [t for _, t in PAGES]
    assert [r["n_chars"] for r in got] == [len(t) for _, t in PAGES]
    assert html_extract.extract(df.filter("false")).count() == 0


def test_long_page():
    page = "<p>" + "word " * 200_000 + "</p>" + "<p>x</p>" * 5000
    assert len(html_extract.main_text(page)) == 5 * 200_000 - 1 + 2 * 5000


def slow_regions(masses, window, share, chars):
    """Surge and dive by their definitions: from each surge walk out to the dives on both sides."""
    n = len(masses)
    total = lambda i: sum(masses[max(i, 0) : max(i + window, 0)])
    sums = [total(i) for i in range(n)]
    least = min(chars, share * max(sums, default=0))
    found = set()
    for i in range(n):
        if sums[i] > 0 and sums[i] >= least:
            a = b = i
            while a > 0 and sums[a - 1] > 0:
                a -= 1
            while b + 1 < n and sums[b + 1] > 0:
                b += 1
            run = [k for k in range(a, min(n, b + window)) if masses[k]]
            found.add((run[0], run[-1] + 1))
    return sorted(found)


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_line_blocks(window):
    assert html_extract.regions([0, 5, 0, 0, 0, 7, 8, 0], 2) == [(1, 2), (5, 7)]
    assert html_extract.regions([0, 5, 0, 0, 0, 700, 0, 0, 0, 60, 60], 2) == [(5, 6), (9, 11)]
    assert html_extract.regions([], 3) == [] and html_extract.regions([0, 0], 3) == []
    rng = np.random.default_rng(window)
    for _ in range(300):
        masses = (rng.integers(0, 4, rng.integers(0, 40)) * rng.integers(0, 60)).tolist()
        for share in (0.0, 0.1, 0.6):
            assert html_extract.regions(masses, window, share) == slow_regions(masses, window, share, html_extract.SURGE_CHARS)


P = [f"Paragraph number {k} says something of its own, and it says it in a whole sentence." for k in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
MENU = "<div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><a href=/c>Sport</a></div><div><a href=/d>More</a></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<h1>T</h1>{BODY}",
        f"{MENU}<h1>T</h1>{BODY}{MENU}<div>© 2020 Someone, all rights reserved</div>",
        f'<body class="home"><div class="site header-fixed"><h1>T</h1>{BODY}</div></body>',
        f'<div class="layout-sidebar-right"><h1>T</h1>{BODY}</div><aside>other things</aside>',
        f'<div class="article-header-image"><h1>T</h1>{BODY}</div>',
        f'<nav><a href=/>x</a><h1>T</h1>{BODY}',
        f'<form action=/ method=post><div class="search"><input><button>Go</button></div><h1>T</h1>{BODY}</form>',
        f"<article><header><h1>T</h1></header>{BODY}</article><footer>f</footer>",
        f"<h1>T</h1>{BODY}<section id=comments><article class=comment><p>{' '.join(P)} {' '.join(P)}</p></article></section>",
        f"<h1>T</h1>{'<div class=ad>buy this now</div><aside>more</aside>'.join(f'<p>{p}</p>' for p in P)}",
        f"<html><head><title>x</title><meta name=a><h1>T</h1>{BODY}",
        f"<b><div><h1>T</b></h1>{BODY}</div>",
        f"<a name=top><h1>T</h1>{BODY}",
        f"<h1>T<button>share</button></h1>{BODY}<div class=related-posts>{MENU}</div><!-- never closed <p>no</p>",
    ],
)
def test_pages_without_help(page):
    """No article element to go by, misleading classes, elements that are never closed."""
    assert html_extract.main_text(page) == "\n".join(["T", *P])


def test_short_ends_of_an_article_stay():
    parts = ["First, a paragraph that is long enough to be the bulk of this page, whatever else may come.", "Yes.", "No."]
    page = "<p>" + "</p><div class=ad>a</div><div class=ad>b</div><nav>c</nav><p>".join(parts) + "</p>"
    assert html_extract.main_text(page) == "\n".join(parts)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<![CDATA[", "<!--", "<", "<div class='", "<b><i></b>", "<form>", "<div><i>", "</i><i><div>", "<p><b>", "<script>", "<a href=", "&amp", "<aside hidden><article>"])
def test_malformed_pages_take_little_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    html_extract.main_text(f"<p>{P[0]}</p>" + page)
    assert time.perf_counter() - start < 10  # in proportion to the page: a square would take hours
    half = time.perf_counter()
    html_extract.main_text(page[: len(page) // 10])
    assert time.perf_counter() - half < 1


def slow_viterbi(hmm, observations):
    score, back = hmm.first() + hmm.emission(observations[0]), []
    for o in observations[1:]:
        step = score[:, None] + hmm.transition(o[3])
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + hmm.emission(o)
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def path_score(hmm, observations, states):
    moves = zip(observations[1:], states, states[1:])
    return hmm.first()[states[0]] + sum(hmm.emission(o)[s] for o, s in zip(observations, states, strict=True)) + sum(hmm.transition(o[3])[a, b] for o, a, b in moves)


def decoded(df, model):
    return {(r["conv_id"], r["turn"], r["part"]): r["role"] for r in chat_format.format_chats(df, model).collect()}


def test_chats(spark, sf):
    """Roles of held-out conversations are recovered from their texts alone."""
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = queries.op9_chat(spark, sf).collect()
    assert {(r["conv_id"], r["turn"]) for r in got} == truth.keys() and len(got) == len(truth)
    for held_out in (True, False):
        assert np.mean([truth[r["conv_id"], r["turn"]] == r["role"] for r in got if r["held_out"] == held_out]) > 0.9


def test_chats_against_whole_viterbi(spark, sf, monkeypatch):
    """Whatever the segments, the states are those of Viterbi over each whole conversation."""
    conversations = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") % 7).alias("conv_id"), (F.col("turn") + 10 * F.floor(F.col("conv_id") / 7)).alias("turn"), "role", "text")
    model = chat_format.train(conversations)
    want = {}
    for conv in range(7):
        rows = conversations.filter(F.col("conv_id") == conv).orderBy("turn").collect()
        found = [chat_format.observe(r["text"])[0] for r in rows]
        states = slow_viterbi(model, [o for f in found for o in f])
        at = 0
        for r, f in zip(rows, found, strict=True):
            opened = [s for s in states[at : at + len(f)] if chat_format.OPENS[s]]
            want |= {(conv, r["turn"], p): chat_format.ROLES[chat_format.ROLE[s]] for p, s in enumerate(opened)}
            at += len(f)
    assert decoded(conversations, model) == want
    for segment, most in ((2, 4096), (100, 2)):
        monkeypatch.setattr(chat_format, "SEGMENT", segment)
        monkeypatch.setattr(chat_format, "MOST", most)
        assert decoded(conversations, model) == want


def test_crowded_turns_keep_their_order(spark, monkeypatch):
    """Repeated turns, equal and not, come in one order however they are cut into segments."""
    rows = [(1, 0, f"what is {k % 37}?" if k % 3 else f"it is {k % 11}\nand more") for k in range(500)] + [(1, 1, "so"), (2, 0, "hm?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    labelled = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "what?" if t % 2 == 0 else "it is\nand") for c in range(20) for t in range(4)], "conv_id long, turn long, role string, text string")
    model = chat_format.train(labelled)
    want = sorted(tuple(r) for r in chat_format.format_chats(df, model).collect())
    assert len(want) == len(rows)
    monkeypatch.setattr(chat_format, "MOST", 5)
    # pieces of 5 copies put equal records further apart, at every size alike: hold it against Viterbi in that order
    texts = sorted((k // 5, r["rank"], r["text"]) for r in chat_format.pieces(df.filter("conv_id = 1 AND turn = 0").dropDuplicates(), "conv_id", "turn", "text").collect() for k in range(sum(x[2] == r["text"] for x in rows)))
    states = slow_viterbi(model, [o for _, _, t in [*texts, (0, 0, "so")] for o in chat_format.observe(t)[0]])
    roles = Counter()
    at = 0
    for _, _, t in texts:
        roles[t, chat_format.ROLES[chat_format.ROLE[states[at]]]] += 1
        at += len(chat_format.observe(t)[0])
    got = Counter((r["text"], r["role"]) for r in chat_format.format_chats(df, model).filter("conv_id = 1 AND turn = 0").collect())
    assert got == roles


def test_segments_give_viterbi(spark, sf):
    model = chat_format.train(spark.read.parquet(f"{sf}/conversations.parquet"))
    rng = np.random.default_rng(0)
    for _ in range(20):
        firsts = [k == 0 or rng.random() < 0.4 for k in range(12)]
        o = [(int(rng.integers(0, 4)), int(rng.integers(0, 5)), int(rng.integers(0, 2)), int(f), int(n)) for f, n in zip(firsts, [*firsts[1:], True])]
        want = slow_viterbi(model, o)
        for path in (model.decode(o, None, want[-1]), model.decode(o, None, None)):
            assert path_score(model, o, path) == pytest.approx(path_score(model, o, want))  # equal but for ties
        joined = (model.transfer(o[:5])[0][:, None] + model.transfer(o[5:])[1]).max(axis=0)
        assert np.allclose(model.transfer(o)[0], joined)


def test_markers(spark, sf):
    """Markers are taken off where they open turns of a transcript; elsewhere they are text."""
    model = chat_format.train(spark.read.parquet(f"{sf}/conversations.parquet"))
    texts = {
        1: "System: be nice\nUser: hi there?\nAssistant: hello\nmore\nAnswer: 42\nUser: thanks",
        2: "The settings are these.\nuser: root\nport: 22\nThat is all of them.",
        3: "a > b and b > c, so a > c",
        4: "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>",
        5: "He asked me this.\nQ: what\nI could not say.",
    }
    df = spark.createDataFrame([(k, 0, t) for k, t in texts.items()], "conv_id long, turn long, text string")
    got = {}
    for r in chat_format.format_chats(df, model).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["marker"]))
    assert got[1] == [("system", "be nice", "System: "), ("user", "hi there?", "User: "), ("assistant", "hello\nmore\nAnswer: 42", "Assistant: "), ("user", "thanks", "User: ")]
    assert [t for _, t, _ in got[2]] == [texts[2]] and [t for _, t, _ in got[3]] == [texts[3]] and [t for _, t, _ in got[5]] == [texts[5]]
    assert [x[:2] for x in got[4]] == [("user", "hi"), ("assistant", "hello")]


def test_odd_chats(spark):
    rows = [(1, 0, None, "hi there?"), (1, 1, "bot", "ok"), (2, None, None, None), (None, 3, "user", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "line\n" * 20_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, part int, range int, copies int")
    got = chat_format.format_chats(df, chat_format.train(df)).collect()
    assert sum(r["conv_id"] == 3 for r in got) == 2 and len(got) == len(rows)
    assert {(r["conv_id"], r["turn"]): r["text"] for r in got}[2, None] == ""
    assert got[0]["rendered"].startswith("<|") and chat_format.format_chats(df.filter("false"), chat_format.train(df.filter("false"))).count() == 0


def test_pipeline(spark, sf, docs):
    state, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, state = state, spark.createDataFrame(stage(spark, state, sf).toPandas())
        if name != "packing":
            assert state.columns == columns
        if name == "near-dedup":
            comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in state.collect()} == set(comp.values())
            assert state.count() == len(set(comp.values()))
        if name == "substring-dedup":
            assert {r["doc_id"] for r in state.collect()} == {r["doc_id"] for r in before.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in state.collect())
    assert {r["doc_id"] for r in state.collect()} <= {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_pipeline_stages_on_odd_rows(spark, sf, which, request):
    df = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert out.count() <= df.count() + 30
        if "text" in out.columns:
            assert out.columns == df.columns


def test_near_dedup_judges_rows_not_ids(spark, sf):
    rng = np.random.default_rng(3)
    a, b, c, d, e, f = (" ".join(f"w{w}" for w in rng.integers(0, 5000, 60)) for _ in range(6))
    rows = [(1, a, "x"), (None, a, "x"), (None, b, "x"), (None, c, "x"), (None, c, "y"), (2, d, "x"), (2, e, "x"), (3, e, "x"), (2, a, "x"), (4, f, "y"), (4, f, "x"), (5, None, "x"), (None, " ", "x")]
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    want = {(1, a, "x"), (None, b, "x"), (None, c, "x"), (2, d, "x"), (2, e, "x"), (4, f, "x"), (5, None, "x")}
    for parts in (1, 5):
        got = [tuple(r) for r in corpus_pipeline.distinct(spark, df.repartition(parts), sf).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("between", ['<div class="ad">x</div><aside>y</aside>', '<div class="ad">x</div> <div class="ad">y</div>\n<nav>z</nav><!-- c --><aside>u<p>v</p></aside>'])
def test_neighbouring_furniture_is_one_gap(between):
    assert html_extract.main_text(f"<p>The first part.</p>{between}<p>B</p><ul><li>C</ul>{between}<p>The last.</p>") == "The first part.\nB\nC\nThe last."
    assert [t for t, _, _ in html_extract.lines_of(f"<p>A</p>{between}<p>B</p>")] == ["A", "", "B"]


@pytest.mark.parametrize("stage", [corpus_pipeline.language, corpus_pipeline.clean])
def test_texts_travel_once_through_a_stage(spark, sf, docs, stage):
    """What goes to the Python workers is each text and, beside it, the columns other than it."""
    out = stage(spark, docs, sf)
    sent = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project [doc_id" in line or "struct(" in line or "named_struct" in line]
    assert sent and not any("named_struct" in line and ("text," in line.split("named_struct", 1)[1]) for line in sent)
    assert out.columns == docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    kept = out.collect()
    assert kept and all(r.text == given[r.doc_id].text and r.source == given[r.doc_id].source for r in kept)

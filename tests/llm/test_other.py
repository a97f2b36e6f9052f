import zlib

import duckdb
import numpy as np
import pytest

from scrivel.llm import html_text, mixing, queries, sharding, topk, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>"; // <</script></head><body class="page">
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu one, two, three and a long entry that has commas</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, and this is a long notice about cookies, so please accept.</div>
<div id="main"><div class="post"><h1>Head &amp; line</h1><p>First&nbsp;paragraph, with  some
<b>bold</b> text, and a <a href="x">link</a>, that goes on for a good while so it counts.<p>Second paragraph, &lt;b&gt; also long, with commas, and more words in it than that.<br>After the break.
<div class="share">Share this, share that, share it all over the place, please, now.</div>
<ul><li>Item one<li>Item two</ul><p>Ok.</p><!-- hidden <p>comment</p> --></div></div>
<aside><p>Sidebar text that is long, has commas, and would score well, were it not an aside, you know.</p></aside>
<section id="comments"><p>Reader comment, which is long, with a lot of commas, and opinions, and a lot more words than needed.</p></section>
<form><p>Subscribe now, to our letter, with your address</p><input></form><footer>&copy; Footer</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "Head & line",
        "First paragraph, with some bold text, and a link, that goes on for a good while so it counts.",
        "Second paragraph, <b> also long, with commas, and more words in it than that. After the break.",
        "Item one",
        "Item two",
        "Ok.",
    ]


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("  \n", ""),
        ("just words", "just words"),
        ("<p>a", "a"),
        ("<article><h1>X</h1><p>Short.</p></article><footer>A much longer footer, with commas, and so on.</footer>", "X\n\nShort."),
        ("<article><p>One</p><p>Cut off<b", "One\n\nCut off"),
        ("<div><p>a &lt; b &amp;amp; c 5 < 6</p></div>", "a < b &amp; c 5 < 6"),
        ("<script>only()", ""),
        ("<article><header><h1>Title</h1></header><p>Body text.</p></article>", "Title\n\nBody text."),
        ("</p></div>stray<b>x</i></b>", "strayx"),
        ("<div hidden><p>no</p></div><div><p>yes</p></div>", "yes"),
    ],
)
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>" + "word, " * 20 + "</p>"
    assert html_text.main_text(deep) == ("word, " * 20).strip()
    assert len(html_text.main_text("<article>" + "<p>some words here</p>" * 20000 + "</article>").split("\n\n")) == 20000


LONG = "A sentence of the article, which has commas, and goes on for long enough to count as a paragraph. "


@pytest.mark.parametrize("attributes", ['class="overflow-hidden"', 'id="content" class="hentry comments-open"', 'class="layout no-sidebar"', 'class="page with-banner"', 'class="site-header-wrap"', 'class="is-hidden-mobile has-sidebar"'])
def test_classes_of_a_state_name_no_part(attributes):
    body = f"<p>{LONG}</p><p>{LONG * 2}</p>"
    got = html_text.main_text(f"<body><nav><a href=x>Menu</a></nav><div {attributes}>{body}</div><div class=sidebar><p>{LONG}</p></div><footer>F</footer></body>")
    assert got == LONG.strip() + "\n\n" + (LONG * 2).strip()


def test_comments_stay_out_however_long():
    page = f"<div class=post><p>{LONG}</p></div><div class='comments-area'><p>{LONG * 20}</p></div><div class='comment-list'><p>{LONG * 9}</p></div>"
    assert html_text.main_text(page) == LONG.strip()


def test_what_stands_in_a_paragraph_and_cited_links_are_text():
    page = f"<article><p>{LONG}<math><mi>x</mi></math> <label>mark</label> <button>press</button></p><ul><li><a href=1>First cited work</a></li><li><a href=2>Second</a></li></ul><button>Share</button><p>{LONG}</p></article>"
    assert html_text.main_text(page).split("\n\n") == [LONG + "x mark press", "First cited work", "Second", LONG.strip()]


@pytest.mark.parametrize("page", ["<a " * 330_000, "<a href='" * 100_000, '<p title="x' * 90_000, "<div>" * 200_000, "<p><b>" * 160_000, "<ul><li>" * 120_000, "</i>" * 250_000, "<" * 1_000_000, "<!--" * 250_000, "<p><button>" + "<div>" * 200_000, "&lt" * 330_000])
def test_a_megabyte_of_odd_markup_takes_linear_time(page):
    import time

    times = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        html_text.main_text(part)
        times.append(time.process_time() - began)
    assert times[1] < 12 * times[0] + 0.5


def test_quotes_count_where_a_value_begins():
    assert html_text.main_text(f"<p class=it's>{LONG}</p><p title='a > b'>{LONG}</p>") == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_extract(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, None, "", None)], "page_id long, url string, html string, text int")
    got = html_text.extract(frame).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert html_text.extract(frame.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    """The article's own text, as the page generator's simple markup shows it."""
    import re
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = r.html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>|<[^>]*$", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert html_text.main_text(r.html) == "\n\n".join(p for p in parts if p), r.page_id


def small(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_shards(spark, docs, rows, odd, empty):
    for limit, bits in ((2000, 3), (2000, 12), (500, 60), (1 << 30, 12)):
        got = {r.doc_id: r for r in sharding.assign_shards(docs, limit, bits).collect()}
        assert len(got) == len(rows)
        h = {r.doc_id: r.h for r in docs.select("doc_id", sharding.hash60("doc_id").alias("h")).collect()}
        size = {r[0]: len((r[1] or "").encode()) for r in rows}
        for d in h:
            depth = next(k for k in range(61) if k == 60 or sum(size[e] for e in h if h[e] >> (60 - k) == h[d] >> (60 - k)) <= limit)
            assert (got[d].depth, got[d].shard, got[d].n_bytes) == (depth, h[d] >> (60 - depth), size[d])
    assert sharding.assign_shards(odd, 100).count() == odd.count()
    assert sharding.assign_shards(empty).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 4000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert back.select("shard_name").distinct().count() > 3


def test_written_shards_with_a_column_of_that_name(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * 50, "mine") for k in range(40)] + [(None, None, None)], "doc_id long, text string, shard_name string")
    sharding.write_shards(docs, str(tmp_path / "s"), 300)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect())) and back.select("shard_name_").distinct().count() > 3


def test_scores_beyond_a_long_raise(spark):
    frame = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(frame)


def brute_topk(rows, k):
    rows = [(i, np.array([int(np.floor(1024 * x)) for x in v], dtype=object)) for i, v in rows]
    out = []
    for i, v in rows:
        if i % 100 == 0:
            scores = sorted((-int((v * w).sum()), j) for j, w in rows if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(4)
    good = [(int(i), rng.normal(0, 0.2, 8).round(2).astype(np.float32).tolist()) for i in range(0, 700)]
    good += [(int(i), [0.5] * 8) for i in range(700, 760)]  # ties
    bad = [(800, None, 1), (900, [1.0, None] + [0.0] * 6, 1), (1000, [float("nan")] * 8, 1), (1100, [float("inf")] * 8, 1), (None, [9.0] * 8, 1)]
    frame = spark.createDataFrame([(*g, 1) for g in good] + bad, "vec_id long, embedding array<float>, g int")
    for rows in (None, 50, 100_000):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, group_rows=rows, block=16).collect())
        assert got == brute_topk(good, 10)
    assert topk.top_k(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0], 1), (5, [-1.0], 1), (0, [2.0], 1)], "vec_id long, embedding array<float>, g int")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 5, -1024 * 1024)]


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    v = np.zeros((4096, 16), dtype=np.int64)
    v[np.arange(4096), np.repeat(np.arange(16), 256)] = rng.integers(500, 1000, 4096)
    index = topk.Index(np.arange(4096), v, 64)
    who, best, scored = index.search(np.array([-1]), v[:1])
    assert scored <= 8 and best[0].tolist() == sorted((v @ v[0]).tolist())[::-1][:10]


def test_targets_are_dealt_again_until_none_is_above():
    t = mixing.targets({"b": 100, "a": 10, None: 50, "": 0}, [5, 2, 1], 1.5, 2)
    assert t[""] == 0 and t["a"] == 20 and abs(sum(t.values()) - 240) < 1e-9 and all(t[s] <= 2 * n for s, n in {"b": 100, "a": 10, None: 50}.items())
    assert mixing.targets({"a": 1, "b": 1}, [5, 2], 3, 2) == {"a": 2.0, "b": 2.0}


def test_flow_is_cheapest():
    # words of {x, y} can serve either quota; repeating y's own words is avoided by routing them
    got = mixing.route({("x",): 100, ("x", "y"): 100, ("y",): 10}, {"x": 100, "y": 110}, 2)
    assert got == {("x",): 100, ("x", "y"): 100, ("y",): 10}
    got = mixing.route({("x",): 10, ("x", "y"): 10}, {"x": 15, "y": 10}, 2)
    assert sum(got.values()) == 25 and got[("x",)] >= 10


def cheapest_flow(patterns, quotas, uses):
    """(words, cost) of the cheapest largest flow, by shortest paths of Bellman and Ford, word by word."""
    nodes = ["start", *patterns, *(("quota", s) for s in quotas), "end"]
    room, cost = {}, {}

    def arc(a, b, k, capacity, price):
        room[a, b, k], room[b, a, -1 - k] = capacity, 0
        cost[a, b, k], cost[b, a, -1 - k] = price, -price

    for p, n in patterns.items():
        for k in range(uses):
            arc("start", p, k, n, k * k)
        for s in p:
            if s in quotas:
                arc(p, ("quota", s), 0, 10**9, 0)
    for s, n in quotas.items():
        arc(("quota", s), "end", 0, n, 0)
    words = paid = 0
    while True:
        far, via = dict.fromkeys(nodes, float("inf")), {}
        far["start"] = 0
        for _ in nodes:
            for (a, b, k), r in room.items():
                if r and far[a] + cost[a, b, k] < far[b]:
                    far[b], via[b] = far[a] + cost[a, b, k], (a, b, k)
        if far["end"] == float("inf"):
            return words, paid
        path, node = [], "end"
        while node != "start":
            path.append(via[node])
            node = via[node][0]
        n = min(room[e] for e in path)
        for a, b, k in path:
            room[a, b, k] -= n
            room[b, a, -1 - k] += n
        words, paid = words + n, paid + n * far["end"]


def test_flow_equals_brute_force():
    import random

    rng = random.Random(8)
    for _ in range(120):
        names = "abcdef"[: rng.randrange(1, 7)]
        patterns = {tuple(sorted(rng.sample(names, rng.randrange(1, min(4, len(names) + 1))))): rng.randrange(0, 9) for _ in range(rng.randrange(1, 9))}
        quotas, uses = {s: rng.randrange(0, 14) for s in names}, rng.randrange(1, 4)
        got = mixing.route(patterns, quotas, uses)
        assert all(0 <= got[p] <= uses * n for p, n in patterns.items())
        cost = sum(sum(k * k * min(max(got[p] - k * n, 0), n) for k in range(uses)) for p, n in patterns.items())
        assert (sum(got.values()), cost) == cheapest_flow(patterns, quotas, uses)
        # the words of each pattern can reach its quotas: their own largest flow takes them all
        flow = mixing.Flow([["abcdef".index(s) for s in p] for p in patterns], [quotas.get(s, 0) for s in "abcdef"])
        assert flow.raise_by([got[p] for p in patterns]) == [got[p] for p in patterns]


def test_many_patterns_take_no_long_time():
    import random
    import time

    rng = random.Random(3)
    names = [f"s{k}" for k in range(3000)]
    patterns = {tuple(sorted(rng.sample(names, rng.randrange(1, 5)))): rng.randrange(1, 1000) for _ in range(100_000)}
    quotas = {s: rng.randrange(0, 40_000) for s in names}
    began = time.process_time()
    got = mixing.route(patterns, quotas, 2)
    assert time.process_time() - began < 120 and sum(got.values()) <= sum(quotas.values())


def brute_targets(sizes, weights, share, most):
    """The level at which sources, each up to its limit, take what is dealt, by halving."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    want = min(share * sum(sizes.values()), most * sum(sizes.values()))
    low, high = 0.0, most * max(sizes.values(), default=0) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * weight[s]) for s in names) < want else (low, mid)
    return {s: min(most * sizes[s], high * weight[s]) for s in names}


def test_targets_equal_brute_force():
    import random

    rng = random.Random(6)
    for _ in range(60):
        sizes = {s: rng.choice([0, 3, 50, 400, 9000]) for s in rng.sample(["a", "b", "B", "é", "z", "", None], rng.randrange(1, 7))}
        got, want = mixing.targets(sizes, [5, 2, 1], 1.5, 2), brute_targets(sizes, [5, 2, 1], 1.5, 2)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), sizes


def check_mix(got, rows):
    size = lambda t: len((t or "").encode().split())
    by = {}
    for _, t, _, s, *_ in rows:
        by[s] = by.get(s, 0) + size(t)
    goal = brute_targets(by, [5, 2, 1], 1.5, 2)
    taken, largest = dict.fromkeys(by, 0), dict.fromkeys(by, 0)
    source = {(r[0], size(r[1])): r[3] for r in rows}
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == by[s] and abs(r.target - goal[s]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in by:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1, (s, taken[s], goal[s])


def test_mix(docs, rows, odd, empty, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check_mix(got, rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    many = spark.createDataFrame([(1, "a b c", ["x", "y"]), (2, "d e", ["x"]), (3, "f", None), (4, "g", [])], "doc_id long, text string, source array<string>")
    out = {r.doc_id: r for r in mixing.mix(many).collect()}
    assert out[4].taken == 0 and out[1].source_size == 8


def test_toxicity(spark, docs, odd, empty):
    base = "/root/testdata/sf0.1"
    frame, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.train(frame, labels)
    held = toxicity.score(frame, model).where("held_out").join(labels, "doc_id").toPandas()
    toxic = held.toxic == 1
    assert (held.predicted[toxic].mean() >= 0.85) and (held.predicted[~toxic].mean() <= 0.01)
    order = held.score.rank()
    n1, n0 = toxic.sum(), (~toxic).sum()
    assert (order[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.96
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_clean(odd, model).count() == odd.count()
    no_labels = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, no_labels).collect()} == {0}


def test_labels_of_held_out_rows_are_not_read(spark):
    base = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    flipped = labels.withColumn("toxic", (toxicity.held_out().cast("int") * 2 - 1) * labels.toxic * -1 + toxicity.held_out().cast("int"))
    a, b = toxicity.train(frame, labels), toxicity.train(frame, flipped)
    assert a.known == b.known and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_risk_is_corrected():
    rng = np.random.default_rng(0)
    word = lambda p: " ".join(["vile"] * p + [f"w{k}" for k in rng.integers(0, 500, 30)]).encode()
    texts = [word(2) for _ in range(60)] + [word(0) for _ in range(400)]
    known = np.arange(460) < 30  # half of the vile texts are unlabelled
    score = toxicity.fit(texts, known, prior=60 / 460).score(texts)
    assert score[:30].min() > score[60:].max() and score[30:60].min() > score[60:].max()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "clicks", "sales"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import common, html_text, knn, language, mixing, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.query(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_cases(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100, None, None, None), (101, "", None, None), (102, "12 !?", None, None), (103, "the " * 50_000, None, None), (104, "und die der", None, None)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], DOCS + ", score double, lang_pred string")
    model = language.learn(docs, F.lit(True))
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    nothing = language.learn(docs.filter("doc_id >= 100"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    empty = docs.limit(0)
    assert language.predict(empty, language.learn(empty, F.lit(True))).count() == 0


def test_mixtures_are_found(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs, F.lit(True))
    texts = {r["lang"]: r["text"] for r in docs.filter("n_chars > 2000").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    half = " ".join(texts["en"].split()[:120] + texts["de"].split()[:80])
    [r] = language.predict(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).collect()
    assert r["lang_pred"] == "en" and 0.4 < r["score"] < 0.8


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = toxicity.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93


def test_toxicity_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    held = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in toxicity.query(spark, sf).filter("held_out").collect() if r["doc_id"] in truth]
    toxic, clean = [[h[1:] for h in held if h[0] == c] for c in (1, 0)]
    assert sum(p for _, p in toxic) / len(toxic) > 0.5 and sum(p for _, p in clean) / len(clean) < 0.01
    above = sum((a > b) + 0.5 * (a == b) for a, _ in toxic for b, _ in clean)
    assert above / (len(toxic) * len(clean)) > 0.7  # area under the curve


def test_toxicity_cases(spark):
    texts = ["you worthless fool", "a fine day by the sea"]
    rows = [(i, texts[i % 2]) for i in range(60)] + [(100, None), (101, ""), (102, "fool " * 40_000)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == 63 and found[0]["predicted"] == 1 and found[1]["predicted"] == 0 and found[102]["predicted"] == 1
    assert found[100]["score"] == found[101]["score"]
    one_class = toxicity.learn(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r["predicted"] for r in toxicity.score(docs, one_class).collect()} == {0}
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_samples_are_bounded(spark):
    rows = spark.range(20_000).withColumn("g", F.when(F.col("id") % 3 == 0, "rare").otherwise("common")).withColumn("h", F.col("id"))
    found = {r["g"]: r["count"] for r in common.least_hashed(rows, "g", "h", 500).groupBy("g").count().collect()}
    assert set(found) == {"rare", "common"} and all(490 <= n <= 500 for n in found.values())
    assert common.least_hashed(rows, "g", "h", 50_000).count() == 20_000
    hot = spark.range(3000).select(F.lit("g").alias("g"), F.lit(1).alias("h"))  # rows of one key stay together
    assert common.least_hashed(hot, "g", "h", 500).count() == 3000 and common.least_hashed(hot.limit(0), "g", "h", 5).count() == 0


def test_mixing_of_very_long_texts_and_one_id(spark):
    rows = [(i, "w " * 50_000, "long") for i in range(4)] + [(9, "x", "hot")] * 300
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == 304 and {r["size"] for r in found} == {50_000, 1}
    assert len({r["taken"] for r in found if r["source"] == "hot"}) == 1  # rows of one id go together


def brute_mix(rows):
    sizes, docs = {}, []
    for d, text, source in rows:
        n = len(__import__("re").findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        docs.append((d, n, source))
    return sizes, docs


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)) if i % 17 else None, rng.choice(["a", "b", "b", "b", None, "c"])) for i in range(4000)]
    rows += [(4000 + i, "x", "tiny") for i in range(3)]
    sizes, docs = brute_mix(rows)
    found = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    taken = {}
    for d, n, source in docs:
        r = found[d]
        assert r["size"] == n and r["source_size"] == sizes[source] and 0 <= r["taken"] <= 2 * n
        taken[source] = taken.get(source, 0) + r["taken"]
    goals = mixing.targets(sizes)
    assert abs(sum(goals.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for source, goal in goals.items():
        assert goal <= 2 * sizes[source] + 1e-9 and 0 <= goal - taken[source] <= 60


def test_mixing_cases(spark):
    schema = "doc_id long, text string, source string, size string, copies string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b", "s", "q", "r"), (1, "a b", "s", "q", "r"), (None, "c", None, None, None), (2, None, "t", None, None)]
    found = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 4 and sorted(r["size"] for r in found) == [0, 1, 2, 2]
    assert mixing.take(spark.createDataFrame([(i, "w w", "s") for i in range(100)], "doc_id long, text string, source string")).count() in range(148, 151)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></ul></nav><div class="ad banner">Buy this now and save</div>
<div id=sidebar><p>Related things that are quite long and have no links at all in them</p></div>
<article><h1>Head &amp; line</h1><p>First   paragraph<br>goes\non.<p>Short.<b>Bold</b> one<script>var t="</p>"</script>
<div class="comments"><p>What a long and thoughtful comment from a reader</p></div><aside>Aside</aside></article>
<form><p>Sign up with your address</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head & line First paragraph goes on. Short.Bold one"
    assert html_text.extract("<div id=main><p>Only a long paragraph without any article around it.</p><p>Two.</p></div><div class=footer>x</div>") == "Only a long paragraph without any article around it. Two."
    assert html_text.extract("plain text, nothing else") == "plain text, nothing else"
    assert html_text.extract("<<<") == "<<<"  # no tag begins so: text
    for page in (None, "", "<nav>menu</nav>", "<p>", "<!-- "):
        assert html_text.extract(page) == ""


STORY = "<p>The main story runs over several sentences, as articles do, and says what there is to say.</p><p>It goes on in a second paragraph.</p>"
TOLD = "The main story runs over several sentences, as articles do, and says what there is to say. It goes on in a second paragraph."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class=menu>Home About Contact</div><div id=main>{STORY}</div>",
        f"<div class=nav>Home About Contact</div><div>{STORY}</div><div class=footer>All rights reserved by us</div>",
        f"<div class=site-header>The Daily Site</div>{STORY}",
        f"<div class=header>The Daily Site</div><div class=post-body>{STORY}</div><div class='siteFooter'>Imprint</div>",
        f"<article>{STORY}<div class=comment-body><p>I liked this story, and I want to say so at length.</p></div></article>",
        f"<article>{STORY}</article><ul class=comments><li class=comment-content>Me too, I liked it very much indeed.</li></ul>",
        f"<article><div class=article-header>{STORY}</div></article>",
        f"<div class=x1><ul>{'<li><a href=1>Some page</a>' * 6}</ul></div><div class=x2>{STORY * 2}</div><div class=x3>{'<div><a href=3>Other</a></div>' * 5}</div>",
        f"<DIV CLASS='navbar main-nav'><ul><li>One<li>Two</ul></DIV><main>{STORY}</main><div id=copyright>c</div>",
    ],
)
def test_furniture_by_class(page):
    assert html_text.extract(page) == " ".join([TOLD] * (page.count(STORY)))


def test_extract_cases(spark, sf_dir):
    pages = spark.createDataFrame([(1, None, "own"), (2, "", "own"), (3, PAGE, "own"), (3, PAGE, "own")], "page_id long, html string, text string")
    found = html_text.extract_text(pages).collect()
    assert sorted(len(r["text"]) for r in found)[:2] == [0, 0] and len(found) == 4
    assert html_text.extract_text(pages.limit(0)).count() == 0
    rows = html_text.query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_judge_replaces_clashing_columns(spark):
    url = "http://a.com/en/x"
    pages = spark.createDataFrame([(1, url, "own", "own"), (1, url, "own", "own"), (2, None, "own", "own"), (3, "http://" + "x." * 30_000 + "org/es/", "own", "own")], "page_id long, url string, host string, verdict string")
    found = urls.judge(pages, urls.BLOCK, urls.ALLOW)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"], r["host"][-3:], r["rule"], r["verdict"]) for r in found.collect()) == [(1, "com", "com/en/", "block"), (1, "com", "com/en/", "block"), (2, "", None, "allow"), (3, "org", "org/es/", "block")]


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(6000)]
    listed = {k for i, k in enumerate(keys) if i % 7 == 0} | {"elsewhere"}
    df = spark.createDataFrame([(k,) for k in keys] + [(None,), (keys[0],)], "key string")
    found = urls.listed(df, "key", spark.createDataFrame([(k,) for k in listed], "key string")).collect()
    assert len(found) == 6002 and all(r["listed"] == (r["key"] in listed) for r in found)
    built = urls.build(spark.createDataFrame([(k,) for k in sorted(listed)], "key string"), df.filter("key IS NOT NULL").distinct())
    assert len(built.levels) >= 2


def brute_rule(url, block, allow):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, rules in (("block", block), ("allow", allow)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_judged_urls(spark):
    samples = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "https://com/en/", "ftp://x.org?/es/", "http://x.org/es/#z", "http://example.net/de/8", "http://notexample.net/de/9", "http://example.net/de/7", "a://b://c/en/", "http://xcom/en/"]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(samples)], "page_id long, url string, host string")
    found = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.judge(df.select("page_id", "url"), urls.BLOCK, urls.ALLOW).collect()}
    for i, u in enumerate(samples):
        assert found[i] == brute_rule(u, urls.BLOCK, urls.ALLOW), u
    assert urls.judge(df.select("page_id", "url").limit(0), urls.BLOCK, urls.ALLOW).count() == 0


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_top_k_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(knn, "QUERY_ROWS", block_rows)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)] + [(300 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(900, None), (920, []), (940, [float("nan")] * 6), (960, [None] + [1.0] * 5), (980, [1.0, 2.0]), (1000, [3.0, 4.0]), (None, [1.0] * 6), (20, [0.25] * 6)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(map(tuple, knn.top_k(df, F.col("id") % 20 == 0, 5).collect()))
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, i, -s) for s, i in scored]
    # rows of one id are queries of one id: its best of all
    best = {}
    for q, i, s in want:
        best.setdefault(q, []).append((-s, i))
    expected = sorted((q, n + 1, i, -s) for q, found in best.items() for n, (s, i) in enumerate(sorted(found)[:5]))
    assert [g for g in got if g[0] != 20] == [e for e in expected if e[0] != 20]
    assert knn.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_of_repeated_queries(spark):
    rng = np.random.default_rng(2)
    some = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)] + [(20, [0.25] * 6)]
    # 25 rows of one id have a cell of their own, from which the id itself gets nothing
    equal = [(20, [4.0, 0.0])] * 25 + [(i, [1.0, float(i % 7)]) for i in range(31, 37)]
    for rows in (some, equal):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = sorted(map(tuple, knn.top_k(df, F.col("id") % 20 == 0, 5).collect()))
        good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
        best = {}
        for q, v in good:
            if q % 20 == 0:
                best.setdefault(q, []).extend((-int(v @ w), i) for i, w in good if i != q)
        assert got == sorted((q, n + 1, i, -s) for q, found in best.items() for n, (s, i) in enumerate(sorted(found)[:5]))


@pytest.mark.parametrize("sent", [0, 64 << 20])
def test_top_k_of_clusters_replicates_few_queries(spark, monkeypatch, sent):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", sent)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8)]) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, asked, parts = knn.replicated(df, F.col("id") % 20 == 0, 5, "vec_id", "embedding", 64.0)
    assert asked.count() < 0.5 * 120 * parts.count()  # every query in every cell would be 1
    got = sorted(map(tuple, knn.top_k(df, F.col("id") % 20 == 0, 5).collect()))
    good = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    score = good[::20] @ good.T
    score[np.arange(120), np.arange(0, 2400, 20)] = -(1 << 60)
    order = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert got == [(20 * q, n + 1, int(i), int(score[q, i])) for q in range(120) for n, i in enumerate(order[q])]

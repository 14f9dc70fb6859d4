"""Known answers of the operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagloom.operators import annotate, cohorts, extract, graph, lists, search
from tagloom.sources import files

TAGS = {4: "dessert", 5: "desserts", 6: "pie", 7: "pies", 8: "cake", 9: "cakes", 10: "gateau"}
MEANT = {1: [4, 5], 2: [6, 7], 3: [8, 9, 10]}


@pytest.fixture(scope="module")
def concepts(spark):
    expressions = spark.createDataFrame([(TAGS[t], r) for r, ts in MEANT.items() for t in ts], "tag string, referent int")
    relations = spark.createDataFrame([(1, 2), (1, 3)], "parent int, child int")
    return expressions, relations


def tags(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "tag string")


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_synonyms_parents_children(spark, concepts):
    expressions, relations = concepts
    assert column(search.synonyms(expressions, tags(spark, "pie")), "tag") == ["pies"]
    assert column(search.synonyms(expressions, tags(spark, "cake")), "tag") == ["cakes", "gateau"]
    assert column(graph.of_tags(graph.children, expressions, relations, tags(spark, "dessert")), "tag") == ["cake", "cakes", "gateau", "pie", "pies"]
    assert column(graph.of_tags(graph.parents, expressions, relations, tags(spark, "pie")), "tag") == ["dessert", "desserts"]
    assert column(graph.of_tags(graph.siblings, expressions, relations, tags(spark, "pie")), "tag") == ["cake", "cakes", "gateau", "pie", "pies"]


def test_neighbourhood(spark, concepts):
    _, relations = concepts
    start = spark.createDataFrame([(1,)], "node int")
    assert {r["node"]: r["weight"] for r in graph.neighbourhood(relations, start, 0.4).collect()} == {1: 1.0, 2: 0.5, 3: 0.5}
    assert {r["node"]: r["weight"] for r in graph.neighbourhood(relations, start, 0.8).collect()} == {1: 1.0}


def test_paths_and_cycles(spark):
    relations = spark.createDataFrame([("dessert", "pie"), ("dessert", "cake")], "parent string, child string")
    assert graph.path_between(relations, "pie", "dessert").first()["path"] == ["pie", "dessert"]
    assert graph.path_between(relations, "pie", "pie").first()["path"] == ["pie"]
    assert graph.path_between(relations, "dessert", "pie").isEmpty()
    with pytest.raises(ValueError):
        graph.add_relation(relations, "cake", "dessert")
    assert graph.add_relation(relations, "cake", "gateau").count() == 3
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert column(graph.cycles(loop), "node") == ["a", "b", "c"]


def test_best_first_values(spark):
    edges = spark.createDataFrame([(f"n{'.' * d}", f"n{'.' * (d + 1)}", round(1 - 0.1 * k, 1)) for d in range(7) for k in range(1, 10)], "parent string, child string, weight double")
    start = spark.createDataFrame([("n",)], "node string")
    found = [r["value"] for r in graph.best_first(edges, start, 0.71).collect()]
    assert found == pytest.approx([1.0, 0.9, 0.81, 0.8, 0.729, 0.72, 0.72])
    assert [r["value"] for r in graph.best_first(edges, start, 0.5).limit(6).collect()] == pytest.approx([1.0, 0.9, 0.81, 0.8, 0.729, 0.72])


def test_aggregate_stops_at_a_share(spark):
    members = spark.createDataFrame([("a", 60.0), ("a", 40.0), ("b", 5.0), ("c", 4.9)], "node string, value double")
    assert [(r["node"], r["value"]) for r in graph.aggregate_members(members, 10).collect()] == [("a", 100.0), ("b", 5.0)]


def test_search_parameters():
    assert search.parse_tokens("12, 'red wine', 12, , -3") == [12, "red wine", -3]
    a, b = search.Search.parse("red", offset=0), search.Search(tags=("red",))
    assert a == b and hash(a) == hash(b)
    with pytest.raises(ValueError):
        search.Search(org="nonsense")


def test_windows_cover_everything_once():
    for size in (0, 1, 9, 10, 23):
        seen, at = [], (0, min(5, size))
        while at and at[0] < at[1]:
            seen += range(*at)
            at = search.next_window(at[0], 5, size)
        assert seen == list(range(size))
    assert search.window(-3, 5, 10) == (0, 5) and search.window(20, 5, 10) == (10, 10)


def test_wildcards_are_literal(spark):
    df = spark.createDataFrame([(1, "100% wool"), (2, "1000 wool"), (3, "a_b"), (4, "axb"), (5, None)], "entity_id int, title string")
    assert column(search.text_scores(df, [["title"]], "0% w"), "entity_id") == [1]
    assert column(search.text_scores(df, [["title"]], "a_b"), "entity_id") == [3]


def test_all_of_adds_and_intersects(spark):
    a, b = (spark.createDataFrame(rows, "entity_id int, score int") for rows in ([(1, 2), (2, 1)], [(2, 3), (3, 1)]))
    assert search.all_of([a, b]).collect() == search.all_of([b, a]).collect() == [(2, 4)]


def test_list_visibility(spark):
    rows = [(1, 9, 0), (2, 9, 1), (3, 9, 2), (4, 5, 1), (5, 7, 2), (6, 3, 1)]
    df = spark.createDataFrame(rows, "list_id int, owner_id int, availability int")
    follows = spark.createDataFrame([(7, 5)], "follower int, followee int")
    assert column(lists.visible_lists(df, follows, 7), "list_id") == [1, 4, 5]
    assert column(lists.visible_lists(df, follows, 7, with_owned=False), "list_id") == [1, 4]
    assert column(lists.visible_lists(df, follows, 7, super_ids=(3,)), "list_id") == [1, 4, 5, 6]


def test_ordering_codec(spark):
    text = "id:4\tklass:Recipe\nid:9\tklass:Site"
    row = spark.range(1).select(lists.load_ordering(F.lit(text)).alias("o")).select("o", lists.dump_ordering(F.col("o")).alias("t"), lists.remove(lists.store(F.col("o"), "Site", F.lit(9)), "Recipe", F.lit(4)).alias("r")).first()
    assert row["o"] == [("Recipe", 4), ("Site", 9)] and row["t"] == text and row["r"] == [("Site", 9)]


def test_merges(spark):
    at = dt.datetime(2024, 1, 1)
    pointers = spark.createDataFrame([(1, 10, False, True, "", at, at), (1, 11, True, False, "late", at, at), (2, 11, True, True, None, at, at)], "user_id int, entity_id int, in_collection boolean, private boolean, comment string, created_at timestamp, updated_at timestamp")
    merged = sorted(lists.absorb(pointers, spark.createDataFrame([(11, 10)], "old int, new int")).select("user_id", "entity_id", "in_collection", "private", "comment").collect())
    assert merged == [(1, 10, True, False, "late"), (2, 10, True, True, None)]
    target = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, t int, v string")
    changed = lists.upsert(target, spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, 1, "e")], "k int, t int, v string"), ["k"], "t")
    assert sorted((r["k"], r["v"]) for r in changed.collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_cohort_metrics(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    # 12 answers share 11 in its week, 13 answers it a week later, 14 answers an invitation that isn't a share
    events = [(1, 1, day(1), "view", None, None), (2, 2, day(2), "view", None, None), (3, 1, day(9), "view", None, None), (11, 3, day(9), "click", True, None), (12, 4, day(10), "signup", None, 11),
              (13, 5, day(16), "purchase", None, 11), (15, 3, day(16), "click", False, None), (14, 5, day(16), "error", None, 15), (16, 4, day(16), "view", None, None)]
    rows = spark.createDataFrame(events, "event_id long, user_id int, ts timestamp_ntz, kind string, shared boolean, of_event long")
    df = cohorts.with_cold_signups(rows)
    found = {cohorts_week(r["bucket"]): r for r in cohorts.metrics(df.withColumn("bucket", cohorts.week_number(F.col("ts"))), 10).collect()}
    names = ("active_users", "dropouts", "cold_signups", "new_users", "net_new_users", "invitation_conversion_rate", "shares_issued", "shares_converted", "shares_clicked", "share_conversion_rate")
    assert {w: tuple(r[n] for n in names) for w, r in found.items()} == {
        "2023-12-31": (2, None, 2, 2, None, None, 0, 0, 0, None),
        "2024-01-07": (1, 1, 1, 2, 1, 1.0, 1, 1, 0, 1.0),
        "2024-01-14": (1, 1, 1, 1, 0, 0.0, 0, 0, 0, None),
    }
    table = {r["metric"]: r for r in cohorts.matrix(cohorts.in_columns(df, cohorts.week_number(F.col("ts")), 2), 10, 2).collect()}
    assert len(table) == 22 and tuple(table["active_users"])[1:] == (2, 1, 1, 3) and tuple(table["dropouts"])[1:] == (None, 1, 1, None)
    assert tuple(table["shares_clicked"])[1:] == (0, 0, 0, 1)


def cohorts_week(number):
    return (dt.date(1970, 1, 4) + dt.timedelta(weeks=number)).isoformat()


UNITS = [("cup", "cup"), ("cloves", "clove"), ("small head", "head"), ("head", "head"), ("pound", "pound"), ("lb", "lb")]
FOODS = [("jalapeño peppers", "1"), ("garlic", "garlic"), ("garlic clove", "garlic clove"), ("lemon", "lemon"), ("lemon zest", "lemon zest"), ("sea salt", "sea salt"), ("salt", "salt")]


@pytest.fixture(scope="module")
def words(spark):
    return tuple(annotate.lexicon(spark.createDataFrame(x, "name string, tag string")) for x in (UNITS, FOODS))


def lines(spark, *texts):
    return annotate.tokens(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i", F.col("text"))


@pytest.mark.parametrize(
    ("text", "place", "words", "value"),
    [("Fourscore and seven years ago ", 2, 1, 7.0), ("Fourscore and 7 1/2 years ago ", 2, 2, 7.5), ("Fourscore and 7/2 years ago", 2, 1, 3.5), ("Fourscore and 7½ years", 2, 1, 7.5), ("Fourscore and 7 ½ years", 2, 2, 7.5)],
)
def test_numbers(spark, text, place, words, value):
    assert [tuple(r) for r in annotate.numbers(lines(spark, text), "i").collect()] == [(0, place, words, value)]


def test_ranges(spark):
    assert sorted(tuple(r) for r in annotate.ranges(lines(spark, "bake 20 to 30 minutes, 5 - 6 people"), "i").collect()) == [(0, 1, 3, 20.0, 30.0), (0, 6, 3, 5.0, 6.0)]


def test_longest_phrase_wins(spark, words):
    found = annotate.phrases(lines(spark, "jalapeño", "jalapeño peppers, and more", "Sea Salt and garlic", "lb. of salt"), "i", words[1]).collect()
    assert sorted((r["i"], r["pos"], r["words"], r["tags"]) for r in found) == [(1, 0, 2, ["1"]), (2, 0, 2, ["sea salt"]), (2, 3, 1, ["garlic"]), (3, 2, 1, ["salt"])]
    assert annotate.phrases(lines(spark, "1 lb. of salt"), "i", words[0]).first()["tags"] == ["lb"]


def test_amounts(spark, words):
    found = annotate.amounts(lines(spark, "fourscore and 1/2 cup ago", "1 small head", "1 1/2 cup", "nothing"), "i", words[0]).collect()
    assert sorted((r["i"], r["pos"], r["words"], r["value"], r["unit"]) for r in found) == [(0, 2, 2, 0.5, "cup"), (1, 0, 3, 1.0, "head"), (2, 0, 3, 1.5, "cup")]


def test_ingredient_lines(spark, words):
    rows = spark.createDataFrame([(0, "2 cloves garlic, crushed"), (1, "Sea salt"), (2, "water")], "i int, text string")
    found = {r["i"]: (r["value"], r["unit"], r["ingredients"], r["comment"]) for r in annotate.ingredient_lines(rows, "i", F.col("text"), *words).collect()}
    assert found == {0: (2.0, "clove", ["garlic"], "crushed"), 1: (None, None, ["sea salt"], ""), 2: (None, None, [], "")}


PAGE = """<html><head><title>A &amp; B</title><meta property="og:url" content="http://x.org/p"><meta name=keywords content="a, b">
<link rel="canonical" href="/canon"><link type="application/rss+xml" href="/rss.xml"></head>
<body><div class="post big"><p>text <a rel="bookmark" href="/b">bm</a></p></div><div class=entry><img src="i.png"><img src="j.png"></div>
<script>var x = "<title>no</title>";</script><a href="/feed/atom">f</a></body></html>"""


def test_glean_and_adopt(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a/b", PAGE), (2, "http://y.org/", None)], "page_id int, url string, html string")
    found = {}
    for r in extract.glean(pages).orderBy("label", "ord").collect():
        found.setdefault(r["label"], []).append(r["value"])
    assert found == {"URI": ["http://x.org/p", "/canon", "/b"], "Image": ["i.png", "j.png"], "Title": ["A & B"], "Tags": ["a, b"], "RSS Feed": ["/rss.xml"]}
    rows = {r["page_id"]: r for r in extract.adopt(extract.glean(pages), pages.select("page_id", "url")).collect()}
    assert (rows[1]["uri"], rows[1]["image"], rows[1]["feeds"]) == ("http://x.org/p", "http://x.org/a/i.png", ["http://x.org/rss.xml"])
    assert rows[2]["uri"] == "http://y.org/" and rows[2]["title"] is None
    assert column(extract.feed_candidates(pages), "link") == ["http://x.org/feed/atom", "http://x.org/rss.xml"]


def test_parts_match_in_turn(spark):
    old = spark.createDataFrame([(1, 10, "p1", "A"), (1, 11, "p2", "B"), (1, 12, "p9", "C")], "page_id int, part_id int, path string, title string")
    new = spark.createDataFrame([(1, 0, "p1", "B"), (1, 1, None, "B"), (1, 2, "q", "Z"), (1, 3, "r", "Y")], "page_id int, n int, path string, title string")
    assert sorted((r["n"], r["part_id"]) for r in extract.match_parts(old, new).collect() if r["part_id"]) == [(0, 10), (1, 11), (2, 12)]


def test_tag_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("pie; pies;,Food,http://x\ncup,Unit,\n")
    assert column(files.tag_dictionary(spark, str(tmp_path / "d.csv")), "name") == ["cup", "pie", "pies"]
    frame = files.server_events(spark.createDataFrame([(1, "a")], "id int, t string"), "item").first()["frame"]
    assert frame == 'event: item\ndata: {"id":1,"t":"a"}\n\n'

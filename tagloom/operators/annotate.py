"""Phrases, numbers and amounts in texts, found by joins of tokens with a lexicon.

Tokens are rows and a lexicon is a prefix tree in a table, walked level by level, so long texts and large lexicons meet in Spark's
joins and nothing is built for words that the lexicon doesn't have. A document's matches come together again only to settle
overlaps, from left to right. Tables as large as the texts meet by sorted merges within their documents' partitions: their size on disk
says little of their rows, by which Spark would send them through the driver. A lexicon goes to all tasks up to BROADCAST_ROWS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import FRACTIONS, WORDS, normalize_name, number_value
from ..sources import files

_TOKEN = r"(\d+/\d+|\d+[½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞]|[\p{L}\p{N}_'’-]+\.?|[^\p{L}\p{N}_\s])"


#: Rows of a lexicon's tree that are sent to all tasks; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def _large(rows: DataFrame) -> DataFrame:
    """Rows that are as many as the texts': never sent to all tasks."""
    return rows.hint("merge")


def _grown(words: DataFrame) -> tuple[DataFrame, int]:
    """A lexicon's tree, stored, with a hint by its size; the words of its longest phrase."""
    tree = files.stored(prefix_tree(words), "lexicon-tree")
    rows, depth = tree.agg(F.count("*"), F.max(F.size(F.split("child", "-")))).first()  # two numbers
    return F.broadcast(tree) if rows <= BROADCAST_ROWS else _large(tree), depth or 1


def tokens(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, token: words (with an abbreviation's point), numbers and signs in order."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))).alias("pos", "token"))


def lexicon(names: DataFrame, name: str = "name", tag: str = "tag") -> DataFrame:
    """phrase (normalised), words, tag of every name."""
    phrase = normalize_name(F.col(name))
    return names.select(phrase.alias("phrase"), F.size(F.split(phrase, "-")).alias("words"), F.col(tag).alias("tag")).filter("phrase <> ''").distinct()


def prefix_tree(words: DataFrame) -> DataFrame:
    """node, word, child, tags: a lexicon as a tree. Nodes are the words so far (the root: the empty text); tags are those of the phrase that a child is, if it is one."""
    parts = F.split("phrase", "-")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "-").alias("node"), F.element_at(parts, i).alias("word"), F.array_join(F.slice(parts, 1, i), "-").alias("child")))
    edges = words.select(F.explode(steps).alias("e")).select("e.*").distinct()
    ends = words.groupBy("phrase").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return edges.join(ends, edges["child"] == ends["phrase"], "left").select("node", "word", "child", "tags")


def stream(found: DataFrame, key: str) -> DataFrame:
    """key, w, word, next, first, last, pos, end: the words of tokens in order, hyphens apart.

    next: the word behind, points and other signs passed over; if a parenthesis opens right behind a word, the one behind
    its end. first and last: whether a word begins and ends its token; end: the token behind it, a point taken in.
    """
    up, down = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key).orderBy(F.desc("pos"))
    normal = normalize_name(F.col("token"))
    named = found.select(key, "pos", "token", F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, "-")).alias("_words"))
    counted = named.withColumn("_before", F.coalesce(F.sum(F.size("_words")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    closed = F.last(F.when(F.col("token") == ")", F.col("_before")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_closed", closed).withColumn("_behind", F.lag("token").over(down))
    size = F.size("_words")
    jump = F.when((F.col("_behind") == "(") & F.col("_closed").isNotNull(), F.col("_closed")).otherwise(F.col("_before") + size)
    end = F.col("pos") + F.when(F.col("_behind") == ".", 2).otherwise(1)
    each = placed.select(key, "pos", end.alias("end"), "_before", size.alias("_size"), jump.alias("_jump"), F.posexplode("_words").alias("_i", "word"))
    last = F.col("_i") == F.col("_size") - 1
    w = F.col("_before") + F.col("_i")
    return each.select(key, w.alias("w"), "word", F.when(last, F.col("_jump")).otherwise(w + 1).alias("next"), (F.col("_i") == 0).alias("first"), last.alias("last"), "pos", "end")


def walk(starts: DataFrame, read: DataFrame, key: str, tree: DataFrame, depth: int) -> DataFrame:
    """starts (key, node, at, anything else) with found (end, phrase, tags): the longest phrase that the tree has below each start's node along the words from `at` on.

    One join with the words and one with the tree a level. The words of all levels are the same exchange, which Spark reuses.
    """
    words = read.select(F.col(key).alias("_key"), F.col("w").alias("_w"), F.col("word").alias("_word"), F.col("next").alias("_next"), F.col("last").alias("_last"), F.col("end").alias("_end"))
    edges = tree.select(F.col("node").alias("_node"), F.col("word").alias("_edge"), F.col("child").alias("_child"), F.col("tags").alias("_tags"))
    kept = [c for c in starts.columns if c not in ("node", "at")]
    state = starts.withColumn("found", F.lit(None).cast("struct<end:int,phrase:string,tags:array<string>>"))
    for _ in range(depth):
        step = state.join(_large(words), (F.col(key) == F.col("_key")) & (F.col("at") == F.col("_w")), "left").join(edges, (F.col("node") == F.col("_node")) & (F.col("_word") == F.col("_edge")), "left")
        here = F.struct(F.col("_end").cast("int").alias("end"), F.col("_child").alias("phrase"), F.col("_tags").alias("tags"))
        state = step.select(*kept, F.col("_child").alias("node"), F.when(F.col("_child").isNotNull(), F.col("_next")).alias("at"), F.when(F.col("_last") & F.col("_tags").isNotNull(), here).otherwise(F.col("found")).alias("found"))
    return state.filter("found IS NOT NULL").select(*kept, "found")


def phrases(found: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """key, pos, words, tags: the longest phrase of the lexicon at each place that no earlier phrase covers; words: the tokens that it takes."""
    (tree, depth), read = _grown(words), stream(found, key)
    roots = tree.filter("node = ''").select("word")
    starts = read.filter("first").join(roots, "word", "left_semi").select(key, "pos", F.lit("").alias("node"), F.col("w").alias("at"))
    hits = walk(starts, read, key, tree, depth).select(key, "pos", (F.col("found.end") - F.col("pos")).alias("words"), "found.tags")
    by_place = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("words")).alias("less"), "tags"))).alias("hits"))
    start = F.struct(F.array().cast("array<struct<pos:int,words:int,tags:array<string>>>").alias("kept"), F.lit(0).alias("free"))
    settled = F.aggregate(
        "hits",
        start,
        lambda acc, h: F.when(
            h["pos"] >= acc["free"],
            F.struct(F.concat(acc["kept"], F.array(F.struct(h["pos"].alias("pos"), (-h["less"]).cast("int").alias("words"), h["tags"].alias("tags")))).alias("kept"), (h["pos"] - h["less"]).cast("int").alias("free")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return by_place.select(key, F.explode(settled).alias("m")).select(key, "m.pos", "m.words", "m.tags")


def phrase_lists(found: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """key, list, nth, pos, words, phrase, tags: lists of phrases such as `chopped almonds, pecans or walnuts`.

    A list begins with a phrase that no phrase or list before it covers. Behind a comma, `and` or `or` the next item may leave
    out words that the first one begins with: the item that shares most of them is meant, of these the longest. `and` and `or`
    lead to the last item. Phrases that stand alone are lists of one. Rounds are as many as the longest list has items.
    """
    (tree, depth), read = _grown(words), files.stored(stream(found, key), "word-stream")
    signs = found.filter(F.lower("token").isin(",", "and", "or")).select(key, F.col("pos").alias("_at"), F.lower("token").alias("_sign"))
    firsts = read.filter("first").select(key, F.col("pos").alias("_pos"), "w")
    roots = tree.filter("node = ''").select("word")
    starts = read.filter("first").join(roots, "word", "left_semi").select(key, "pos", F.lit("").alias("node"), F.col("w").alias("at"))
    heads = walk(starts, read, key, tree, depth)
    items = files.stored(heads.select(key, F.col("pos").alias("list"), F.lit(1).alias("nth"), "pos", "found"), "phrase-lists")
    parted = F.split("found.phrase", "-")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parted) - 1), lambda i: F.struct(i.alias("shared"), F.array_join(F.slice(parted, 1, i), "-").alias("node")))
    paths = items.select(key, "list", F.explode(prefixes).alias("p")).select(key, "list", "p.shared", "p.node")
    parts, last = [items], items.select(key, "list", F.col("found.end").alias("_end"))
    nth = 1
    while True:
        nth += 1
        # a comma may have `and` or `or` behind it
        one = last.join(_large(signs), (last[key] == signs[key]) & (F.col("_end") == F.col("_at"))).select(last[key], "list", "_sign", (F.col("_end") + 1).alias("_pos"))
        two = signs.filter("_sign <> ','").select(F.col(key).alias("_k"), F.col("_at").alias("_p"), F.lit(True).alias("_two"))
        ahead = one.join(_large(two), (one[key] == F.col("_k")) & (F.col("_pos") == F.col("_p")) & (F.col("_sign") == ","), "left")
        ahead = ahead.select(key, "list", ((F.col("_sign") == ",") & F.col("_two").isNull()).alias("_more"), (F.col("_pos") + F.coalesce(F.col("_two").cast("int"), F.lit(0))).alias("_pos"))
        begun = ahead.join(_large(firsts), [key, "_pos"]).join(_large(paths), [key, "list"]).select(key, "list", F.col("_pos").alias("pos"), "_more", "shared", "node", F.col("w").alias("at"))
        best = walk(begun, read, key, tree, depth).groupBy(key, "list").agg(F.max(F.struct("shared", "found.end", "pos", "_more", "found")).alias("b"))
        new = files.stored(best.select(key, "list", F.lit(nth).alias("nth"), "b.pos", "b.found", "b._more"), "phrase-lists")
        if new.isEmpty():
            break
        parts.append(new.drop("_more"))
        last = new.filter("_more").select(key, "list", F.col("found.end").alias("_end"))
    whole = reduce(DataFrame.unionByName, parts)
    # of lists that overlap the earlier one stays
    spans = whole.groupBy(key, "list").agg(F.max("found.end").alias("_end")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("list", "_end"))).alias("s"))
    kept = F.aggregate("s", F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("free")), lambda acc, x: F.when(x["list"] >= acc["free"], F.struct(F.concat(acc["kept"], F.array(x["list"])).alias("kept"), x["_end"].alias("free"))).otherwise(acc), lambda acc: acc["kept"])
    chosen = spans.select(key, F.explode(kept).alias("list"))
    return whole.join(_large(chosen), [key, "list"]).select(key, "list", "nth", "pos", (F.col("found.end") - F.col("pos")).alias("words"), "found.phrase", "found.tags")


def numbers(found: DataFrame, key: str) -> DataFrame:
    """key, pos, words, value: whole numbers, fractions, glyphs, number words, and a whole number with a fraction behind it."""
    glyphs = "".join(FRACTIONS) + "⅐"
    is_whole, is_part = F.col("token").rlike(r"^\d+$"), F.col("token").rlike(rf"^(\d+/\d+|[{glyphs}])$")
    single = found.filter(is_whole | is_part | F.col("token").rlike(rf"^\d+[{glyphs}]$") | F.lower("token").isin(list(WORDS)))
    part = found.filter(is_part).select(key, (F.col("pos") - 1).alias("pos"), F.col("token").alias("part"))
    mixed = found.filter(is_whole).join(_large(part), [key, "pos"]).select(key, "pos", F.lit(2).alias("words"), number_value(F.concat_ws(" ", "token", "part")).alias("value"))
    taken = mixed.select(key, F.explode(F.array("pos", F.col("pos") + 1)).alias("pos"))
    rest = single.join(_large(taken), [key, "pos"], "left_anti").select(key, "pos", F.lit(1).alias("words"), number_value(F.col("token")).alias("value"))
    return mixed.unionByName(rest)


def ranges(found: DataFrame, key: str) -> DataFrame:
    """key, pos, words, low, high: `2 to 3`, `2 - 3`, `2 or 3`."""
    n = numbers(found, key)
    between = found.filter(F.lower("token").isin("to", "or", "-", "–")).select(key, F.col("pos").alias("sign"))
    left = n.select(key, "pos", F.col("value").alias("low"), F.col("words").alias("w1"), (F.col("pos") + F.col("words")).alias("sign"))
    right = n.select(key, (F.col("pos") - 1).alias("sign"), F.col("value").alias("high"), F.col("words").alias("w2"))
    return left.join(_large(between), [key, "sign"]).join(_large(right), [key, "sign"]).select(key, "pos", (F.col("w1") + F.col("w2") + 1).alias("words"), "low", "high")


def amounts(found: DataFrame, key: str, units: DataFrame) -> DataFrame:
    """key, pos, words, value, unit: a number and the unit right behind it, or after one word (`1 small head`)."""
    n = numbers(found, key)
    u = phrases(found, key, units).select(key, F.col("pos").alias("at"), F.col("words").alias("more"), F.get("tags", F.lit(0)).alias("unit"))
    near = reduce(DataFrame.unionByName, [n.select(key, "pos", "value", F.lit(gap).alias("gap"), (F.col("pos") + F.col("words") + gap).alias("at"), "words") for gap in (0, 1)])
    best = near.join(_large(u), [key, "at"]).groupBy(key, "pos").agg(F.min(F.struct("gap", (F.col("words") + F.col("gap") + F.col("more")).alias("words"), "value", "unit")).alias("b"))
    return best.select(key, "pos", "b.words", "b.value", "b.unit")


def ingredient_lines(lines: DataFrame, key: str, text: Column, units: DataFrame, ingredients: DataFrame) -> DataFrame:
    """key, value, unit, ingredients, comment of lines: an amount, then names of ingredients, then anything."""
    found = tokens(lines, key, text)
    first = amounts(found, key, units).groupBy(key).agg(F.min(F.struct("pos", "words", "value", "unit")).alias("a"))
    names = phrases(found, key, ingredients).groupBy(key).agg(F.array_sort(F.collect_set(F.get("tags", F.lit(0)))).alias("ingredients"))
    comment = F.regexp_extract(text, r"[,(](.*)$", 1)
    return lines.select(key, F.trim(comment).alias("comment")).join(_large(first), key, "left").join(_large(names), key, "left").select(key, "a.value", "a.unit", F.coalesce("ingredients", F.array().cast("array<string>")).alias("ingredients"), "comment")

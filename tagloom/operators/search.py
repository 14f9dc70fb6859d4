"""Ranked search: per search tag, text, tagging, synonym and comment matches add up; tags combine with AND."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normalize_name

#: Orderings: the column of found entities that each goes by, and whether its greatest come first.
ORGS = {
    "relevance": ("score", True),
    "newest": ("created_at", True),
    "oldest": ("created_at", False),
    "updated": ("updated_at", True),
    "alphabetic": ("title", False),
    "popularity": ("popularity", True),
    "viewed": ("viewed_at", True),
    "random": ("chance", False),
    "posted": ("posted_at", True),
    "activity": ("activity", True),
    "ratings": ("rating", True),
    "approved": ("approved_at", True),
}


def like(column: Column, text: str) -> Column:
    """Case-insensitive substring; wildcards in the text stand for themselves."""
    escaped = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return F.coalesce(column.ilike(f"%{escaped}%"), F.lit(False))


def text_scores(entities: DataFrame, scopes: list[list[str]], text: str) -> DataFrame:
    """entity_id, score: 1 for each scope (columns joined by OR) that holds the text, and 1 for each that equals it."""
    hits = []
    for scope in scopes:
        hits.append(reduce(Column.__or__, [like(F.col(c), text) for c in scope]).cast("int"))
        hits.append(reduce(Column.__or__, [F.coalesce(F.lower(c) == text.lower(), F.lit(False)) for c in scope]).cast("int"))
    return entities.select("entity_id", reduce(Column.__add__, hits).alias("score")).filter("score > 0")


def tagging_scores(taggings: DataFrame, tags: DataFrame, expressions: DataFrame, text: str) -> DataFrame:
    """entity_id, score: 1 each for a tag that holds the text, that is the text, that is a synonym of such a tag."""
    name = normalize_name(F.lit(text))
    exact = tags.filter(F.col("normalized_name") == name).select("tag")
    fuzzy = tags.filter(F.contains("normalized_name", name)).select("tag")
    similar = synonyms(expressions, exact)
    on = taggings.select("entity_id", "tag").distinct()
    found = [on.join(t.distinct(), "tag", "left_semi").select("entity_id").distinct() for t in (fuzzy, exact, similar)]
    return reduce(DataFrame.unionByName, found).groupBy("entity_id").agg(F.count("*").cast("int").alias("score"))


def synonyms(expressions: DataFrame, tags: DataFrame) -> DataFrame:
    """Other tags that express what the given tags express."""
    meant = expressions.join(tags, "tag", "left_semi").select("referent").distinct()
    return expressions.join(meant, "referent", "left_semi").select("tag").distinct().join(tags, "tag", "left_anti")


def comment_scores(pointers: DataFrame, text: str) -> DataFrame:
    """entity_id, score: 1 for entities on which any collector's comment holds the text."""
    return pointers.filter(like(F.col("comment"), text)).select("entity_id").distinct().withColumn("score", F.lit(1))


def all_of(scores: list[DataFrame]) -> DataFrame:
    """Entities that every search tag has found, their scores added."""
    renamed = [s.withColumnRenamed("score", f"s{i}") for i, s in enumerate(scores)]
    joined = reduce(lambda a, b: a.join(b, "entity_id"), renamed)
    return joined.select("entity_id", reduce(Column.__add__, [F.col(f"s{i}") for i in range(len(scores))]).cast("int").alias("score"))


def any_of(contributions: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select("entity_id", F.col("score").cast("int").alias("score")) for c in contributions]).groupBy("entity_id").agg(F.sum("score").cast("int").alias("score"))


def found(entities: DataFrame, scopes: list[list[str]], pointers: DataFrame, tagged: DataFrame, tags: DataFrame, expressions: DataFrame, words: list[str], viewer: int | None = None) -> DataFrame:
    """Entities that every word has found: entities' columns, score, and what orderings go by.

    posted_at: when it was last pointed to first; activity: all edits; rating: the share of pointers that hold it; approved_at: when
    somebody last held it for all to see. Each word scores as text_scores, tagging_scores and comment_scores say; all words are looked for in one pass over each table.
    tagged: entity_id and tag of entities that count as tagged if any user points to them. viewed_at is the viewer's own.
    """
    n = range(len(words))
    names = [normalize_name(F.lit(w)) for w in words]
    # tags that are a word, hold it, or are synonyms of one that is it
    exact = tags.select("tag", *[(F.col("normalized_name") == names[i]).alias(f"exact{i}") for i in n], *[F.contains("normalized_name", names[i]).alias(f"fuzzy{i}") for i in n])
    expressed = expressions.select("tag", "referent").distinct().join(exact, "tag", "left")
    meant = expressed.groupBy("referent").agg(*[F.bool_or(F.coalesce(f"exact{i}", F.lit(False))).alias(f"meant{i}") for i in n]).filter(reduce(Column.__or__, [F.col(f"meant{i}") for i in n]))
    similar = expressed.select("tag", "referent").join(meant, "referent").groupBy("tag").agg(*[F.bool_or(f"meant{i}").alias(f"similar{i}") for i in n])
    flags = exact.join(similar, "tag", "full")
    kinds = {f"{k}{i}": F.coalesce(F.col(f"{k}{i}"), F.lit(False)) for k in ("exact", "fuzzy") for i in n}
    kinds |= {f"similar{i}": F.coalesce(F.col(f"similar{i}") & ~kinds[f"exact{i}"], F.lit(False)) for i in n}
    flags = flags.select("tag", *[c.alias(k) for k, c in kinds.items()]).filter(reduce(Column.__or__, [F.col(k) for k in kinds]))
    by_tag = tagged.join(flags, "tag").groupBy("entity_id").agg(*[F.bool_or(k).alias(k) for k in kinds])
    pointed = pointers.groupBy("entity_id").agg(
        *[F.bool_or(like(F.col("comment"), w)).alias(f"comment{i}") for i, w in enumerate(words)],
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.count_if("in_collection").alias("popularity"),
        F.max("created_at").alias("posted_at"),
        F.sum("edit_count").alias("activity"),
        (F.count_if("in_collection") / F.count("*")).alias("rating"),
        F.max(F.when(F.col("in_collection") & ~F.col("private"), F.col("created_at"))).alias("approved_at"),
        F.max(F.when(F.col("user_id") == (viewer if viewer is not None else F.lit(None)), F.col("updated_at"))).alias("viewed_at"),
    )
    rows = entities.join(pointed.join(by_tag, "entity_id", "left"), "entity_id", "left")
    scores = []
    for i, w in enumerate(words):
        texts = [reduce(Column.__or__, [like(F.col(c), w) for c in scope]) for scope in scopes]
        texts += [reduce(Column.__or__, [F.coalesce(F.lower(c) == w.lower(), F.lit(False)) for c in scope]) for scope in scopes]
        hits = [*texts, *[F.coalesce(F.col(f"{k}{i}"), F.lit(False)) for k in ("exact", "fuzzy", "similar", "comment")]]
        scores.append(reduce(Column.__add__, [h.cast("int") for h in hits]))
    rows = rows.withColumns({f"_s{i}": x for i, x in enumerate(scores)}).filter(reduce(Column.__and__, [F.col(f"_s{i}") > 0 for i in n]))
    rows = rows.withColumn("score", reduce(Column.__add__, [F.col(f"_s{i}") for i in n])).withColumn("popularity", F.coalesce("popularity", F.lit(0)))
    return rows.select(*entities.columns, "score", "created_at", "updated_at", "popularity", "viewed_at", "posted_at", "activity", "rating", "approved_at", F.md5(F.col("entity_id").cast("string")).alias("chance"))


def order_of(asked: Search) -> list[Column]:
    """The ordering that a search asks for; what it goes by comes last where it is missing, and ties go to the smaller id."""
    name, greatest_first = ORGS[asked.org]
    down = greatest_first == asked.descending
    return [F.desc_nulls_last(name) if down else F.asc_nulls_last(name), F.asc("entity_id")]


def page(ranked: DataFrame, order: list[Column], offset: int = 0, limit: int = 10) -> DataFrame:
    """A window of the ordered rows, with their ranks from 1 on."""
    rows = ranked.orderBy(*order).offset(offset).limit(limit)  # at most `limit` rows from here on
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) + offset).cast("int"))


def parse_tokens(text: str) -> list[int | str]:
    """A comma-separated list: numbers are ids, the rest strings without quotes; each once, blanks dropped."""
    found: list[int | str] = []
    for raw in text.split(","):
        token = raw.strip().strip("'\"").strip()
        value = int(token) if token.lstrip("-").isdigit() else token
        if token and value not in found:
            found.append(value)
    return found


def query_tags(asked: DataFrame, tags: DataFrame, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """session, place, id, name of the tags that tokens mean; and the sessions' special tags afterwards.

    asked: session, place, token. tags: id (above 0), name, normalized_name. special: session, id (below 0), name. A number is the id of a tag, a
    negative one of a special tag of the session; ids of none give no row. Anything else is a name, quotes taken off: that of a
    tag (of several the least id), of a special tag of the session, or of a new one, which takes the next free number.
    """
    token = F.trim(F.regexp_replace(F.trim("token"), "['\"]", ""))
    read = asked.select("session", "place", token.alias("token"), F.trim("token").rlike(r"^\d+$").alias("_id"), F.trim("token").rlike(r"^-\d+$").alias("_special")).filter("token <> ''")
    number = F.expr("try_cast(token AS bigint)")
    by_id = read.filter("_id").withColumn("id", number).join(tags.select("id", "name"), "id").select("session", "place", "id", "name")
    by_special = read.filter("_special").withColumn("id", number).join(special, ["session", "id"]).select("session", "place", "id", "name")
    names = read.filter("NOT _id AND NOT _special").select("session", "place", F.col("token").alias("name"), normalize_name(F.col("token")).alias("normalized_name"))
    known = tags.groupBy("normalized_name").agg(F.min_by(F.struct("id", "name"), "id").alias("t"))
    met = names.join(known, "normalized_name", "left").join(special.withColumnRenamed("id", "_sid"), ["session", "name"], "left")
    lowest = special.groupBy("session").agg(F.min("id").alias("_low"))
    new = met.filter("t IS NULL AND _sid IS NULL").groupBy("session", "name").agg(F.min("place").alias("_first"))
    new = new.join(lowest, "session", "left").withColumn("id", F.coalesce("_low", F.lit(0)) - F.row_number().over(Window.partitionBy("session").orderBy("_first"))).select("session", "name", F.col("id").cast("long").alias("id"))
    named = met.join(new.withColumnRenamed("id", "_new"), ["session", "name"], "left").select("session", "place", F.coalesce("t.id", "_sid", "_new").alias("id"), F.coalesce("t.name", "name").alias("name"))
    return by_id.unionByName(by_special).unionByName(named), special.unionByName(new)


def split_tokens(text: str) -> list[str]:
    """A comma-separated list as it is written: numbers without quotes are ids, everything else names."""
    return [token for raw in text.split(",") if (token := raw.strip())]


@dataclass(frozen=True)
class Search:
    """What is asked for; equal searches have equal keys, under which results can be kept.

    descending: the ordering as it is named; otherwise the other way round. viewer: whose views `viewed` goes by.
    """

    tags: tuple[str, ...] = ()
    org: str = "relevance"
    descending: bool = True
    offset: int = 0
    limit: int = 10
    viewer: int | None = None

    def __post_init__(self):
        if self.org not in ORGS:
            raise ValueError(f"no ordering named {self.org}; there are {', '.join(ORGS)}")

    @classmethod
    def parse(cls, text: str, **more) -> Search:
        return cls(tags=tuple(str(t) for t in parse_tokens(text)), **more)


def window(offset: int, limit: int, size: int) -> tuple[int, int]:
    """First and end of a window, clipped to the size."""
    first = min(max(offset, 0), size)
    return first, min(first + max(limit, 0), size)


def next_window(offset: int, limit: int, size: int) -> tuple[int, int] | None:
    first, end = window(offset + limit, limit, size)
    return (first, end) if first < end else None

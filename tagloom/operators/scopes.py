"""Declared scopes: which columns of which entities a string is looked for in, and which rows each kind of result shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import like


@dataclass(frozen=True)
class Match:
    """One scope of an entity type: its rows, joined with what they lead to, and the columns to look in (joined by OR)."""

    entity_type: str
    scope: str
    rows: Callable[..., DataFrame]
    key: str
    columns: tuple[str, ...]


def match(specs: list[Match], source, text: str) -> DataFrame:
    """entity_type, scope, entity_id (as text), each once, of all that holds the text. source: what the specs' rows are made from."""
    found = []
    for spec in specs:
        hit = reduce(Column.__or__, [like(F.col(c), text) for c in spec.columns])
        rows = spec.rows(source).filter(hit)
        found.append(rows.select(F.lit(spec.entity_type).alias("entity_type"), F.lit(spec.scope).alias("scope"), F.col(spec.key).cast("string").alias("entity_id")).distinct())
    return reduce(DataFrame.unionByName, found)


def where(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values (lists: one of them); None asks for nothing."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.filter(F.col(name).isin(list(value)))
        elif value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def available(tags: DataFrame, name: str, types: list[int] | None = None, strict: bool = True) -> bool:
    """Whether there is a tag of a name; not strict: also where only its normalised name is the same."""
    from ..functions.scalars import normalize_name

    test = F.col("name") == name if strict else F.col("normalized_name") == normalize_name(F.lit(name))
    return not where(tags, tagtype=types).filter(test).limit(1).isEmpty()


def preferred(rows: DataFrame, key: str, wishes: list[Column], tie: str) -> DataFrame:
    """One row a key: one for which the first wish holds, else the second, ..., else any; ties by a column."""
    rank = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(wishes)], F.lit(len(wishes)))
    best = F.min_by(F.struct(*rows.columns), F.struct(rank, F.col(tie)))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("b")).select("b.*")


#: States of a background job: what a launch and a landing make of them.
VIRGIN, PROCESSING, GOOD, BAD = "virgin", "processing", "good", "bad"


def launched(status: Column, force: bool = False) -> Column:
    """A job is queued if it never ran or went wrong (or if forced), but never twice at a time."""
    return F.when(status == PROCESSING, status).when(status.isin(VIRGIN, BAD) | F.lit(force), F.lit(PROCESSING)).otherwise(status)


def landed(status: Column, error: Column) -> Column:
    return F.when(status != PROCESSING, status).when(error.isNull(), F.lit(GOOD)).otherwise(F.lit(BAD))


def tri_state(state: Column, wanted: bool | None) -> Column:
    """Whether a state is the wanted one; None wants it unknown."""
    return state.isNull() if wanted is None else F.coalesce(state == wanted, F.lit(False))


def ranked(rows: DataFrame, by: list[str], order: list[str], path: str, name: str = "rank") -> DataFrame:
    """rows with their rank (from 0) in each group: few groups of any size, for no task orders a whole one.

    Rows are dealt out by ranges of groups and order and stored below `path`; ranks are those within a range, and the rows of the group in ranges before.
    """
    dealt = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    return dealt.withColumn("_own", F.row_number().over(own) - 1).join(counts, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")

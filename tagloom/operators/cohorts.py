"""Cohort analytics over an event log: one aggregation for all intervals, and a matrix of metrics by interval.

Intervals are half open, so an event at a boundary counts once. An interval's number is its `bucket`:
prior and next intervals are one less and one more; ALL_TIME stands for everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio

#: What the event types stand for: an invitation is sent, clicked, accepted (converted) or diverted; views are logins.
LOGIN, SENT, CLICKED, ACCEPTED, DIVERTED = "view", "click", "purchase", "signup", "error"
#: Signing up without an invitation.
COLD = "cold"
METRICS = (
    "active_users", "sessions_per_active_user", "dropouts", "new_users", "accepted_invitations", "cold_signups", "net_new_users", "viral_coefficient",
    "invitations_issued", "invitations_clicked", "invitation_click_rate", "invitations_converted", "invitation_conversion_rate", "invitations_diverted", "invitation_response_conversion_rate",
    "shares_issued", "shares_clicked", "share_click_rate", "shares_converted", "share_conversion_rate", "shares_diverted", "share_response_conversion_rate",
)
SHARES = METRICS[15:]
ALL_TIME = 1_000_000
#: The Sunday from which weeks are counted.
SUNDAY = "1970-01-04"


def week_number(ts: Column) -> Column:
    """Weeks since SUNDAY; they begin on Sundays."""
    return F.floor(F.datediff(ts, F.lit(SUNDAY).cast("date")) / 7).cast("int")


def week_start(number: Column) -> Column:
    return F.date_add(F.lit(SUNDAY).cast("date"), number * 7)


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def month_label(number: Column) -> Column:
    """Like 1/24."""
    return F.concat((number % 12 + 1).cast("string"), F.lit("/"), F.substring(F.floor(number / 12).cast("string"), 3, 2))


def with_cold_signups(events: DataFrame) -> DataFrame:
    """events (event_id, ts, user_id, kind, ...) and a row of the kind COLD for each user who never accepted an invitation, at their first event."""
    firsts = events.groupBy("user_id").agg(F.min("ts").alias("ts"), F.bool_or(F.col("kind") == ACCEPTED).alias("_invited"))
    cold = firsts.filter("NOT _invited").select("user_id", "ts", F.lit(COLD).alias("kind"))
    return events.unionByName(cold, allowMissingColumns=True)


def in_columns(events: DataFrame, number: Column, columns: int) -> DataFrame:
    """events by the report's columns: 0 to columns - 1 end with the last event's interval, -1 is all time before, and each counts in ALL_TIME, too."""
    last = events.agg(F.max(number).alias("_last"))  # one row
    place = F.greatest(F.lit(-1), number - F.col("_last") + columns - 1).cast("int")
    return events.crossJoin(F.broadcast(last)).withColumn("bucket", F.explode(F.array(place, F.lit(ALL_TIME)))).drop("_last")


def dropouts(events: DataFrame) -> DataFrame:
    """bucket, _gone: users who logged in during the bucket before and not in this one."""
    active = events.filter((F.col("kind") == LOGIN) & (F.col("bucket") < ALL_TIME)).select("bucket", "user_id").distinct()
    before = active.select((F.col("bucket") + 1).alias("bucket"), "user_id")
    return before.join(active, ["bucket", "user_id"], "left_anti").groupBy("bucket").agg(F.count("*").alias("_gone"))


def metrics(events: DataFrame, users: int, first: int | None = None) -> DataFrame:
    """One row a bucket with all metrics. events: bucket, event_id, user_id, kind, shared and of_event (the invitation that an answer answers).

    first: the bucket that has none before it (None: the least). An invitation to something is a share;
    answers to shares count where both fall into the same bucket.
    """

    def count(kind):
        return F.count_if(F.col("kind") == kind)

    sent = events.filter((F.col("kind") == SENT) & F.col("shared"))
    answers = events.filter(F.col("kind").isin(CLICKED, ACCEPTED, DIVERTED)).select("bucket", F.col("of_event").alias("event_id"), "kind")
    shared = sent.select("bucket", "event_id").join(answers, ["bucket", "event_id"]).groupBy("bucket").agg(count(CLICKED).alias("_clicked"), count(ACCEPTED).alias("_converted"), count(DIVERTED).alias("_diverted"))
    per = events.groupBy("bucket").agg(
        F.count_distinct(F.when(F.col("kind") == LOGIN, F.col("user_id"))).alias("active_users"),
        count(LOGIN).alias("_logins"),
        count(ACCEPTED).alias("accepted_invitations"),
        count(COLD).alias("cold_signups"),
        count(SENT).alias("invitations_issued"),
        count(CLICKED).alias("invitations_clicked"),
        count(DIVERTED).alias("invitations_diverted"),
        F.count_if((F.col("kind") == SENT) & F.col("shared")).alias("shares_issued"),
    )
    none_before = F.min("bucket").over(Window.partitionBy(F.lit(1))) if first is None else F.lit(first)  # a row a bucket
    with_prior = (F.col("bucket") > none_before) & (F.col("bucket") < ALL_TIME)
    c = F.col
    return (
        per.join(dropouts(events), "bucket", "left")
        .join(shared, "bucket", "left")
        .withColumn("sessions_per_active_user", ratio(c("_logins"), c("active_users")))
        .withColumn("dropouts", F.when(with_prior, F.coalesce("_gone", F.lit(0))))
        .withColumn("new_users", c("accepted_invitations") + c("cold_signups"))
        .withColumn("net_new_users", c("new_users") - c("dropouts"))
        .withColumn("viral_coefficient", ratio(c("accepted_invitations"), F.lit(users)))
        .withColumn("invitations_converted", c("accepted_invitations"))
        .withColumn("invitation_click_rate", ratio(c("invitations_clicked"), c("invitations_issued")))
        .withColumn("invitation_conversion_rate", ratio(c("invitations_converted"), c("invitations_issued")))
        .withColumn("invitation_response_conversion_rate", ratio(c("invitations_converted"), c("invitations_clicked")))
        .withColumn("shares_clicked", F.coalesce("_clicked", F.lit(0)))
        .withColumn("shares_converted", F.coalesce("_converted", F.lit(0)))
        .withColumn("shares_diverted", F.coalesce("_diverted", F.lit(0)))
        .withColumn("share_click_rate", ratio(c("shares_clicked"), c("shares_issued")))
        .withColumn("share_conversion_rate", ratio(c("shares_converted"), c("shares_issued")))
        .withColumn("share_response_conversion_rate", ratio(c("shares_converted"), c("shares_clicked")))
        .select("bucket", *METRICS)
    )


def matrix(events: DataFrame, users: int, columns: int) -> DataFrame:
    """metric, before, i0 ... of the last intervals, all_time. events: as in_columns gives them."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    long = metrics(events, users, -1).select("bucket", F.explode(pairs).alias("p")).select("bucket", "p.metric", "p.value")
    names = {-1: "before", **{i: f"i{i}" for i in range(columns)}, ALL_TIME: "all_time"}
    found = long.groupBy("metric").pivot("bucket", list(names)).agg(F.first("value"))
    return found.select("metric", *[F.col(f"`{b}`").alias(n) for b, n in names.items()])

"""Queries of cohort analytics, event windows and mail reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts
from ..sources import roles

#: Intervals of a report, besides all time before and all time.
COLUMNS = 3


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with what invitations are about: one with an even key shares something, an answer is to the event that many and one before it."""
    e = roles.table(spark, folder, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return cohorts.with_cold_signups(e.select("event_id", "ts", "user_id", "kind", (F.col("k") % 2 == 0).alias("shared"), (F.col("event_id") - F.col("k") - 1).alias("of_event")))


def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    found = cohorts.metrics(_events(spark, folder).withColumn("bucket", cohorts.week_number(F.col("ts"))), _users(spark, folder))
    return found.withColumn("week", cohorts.week_start(F.col("bucket")))


def _users(spark: SparkSession, folder: str) -> int:
    return roles.users(spark, folder).count()


def cohort_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """COH-1..11: all metrics of every week."""
    return _weekly(spark, folder).select("week", *cohorts.METRICS)


def cohort_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """COH-12, COH-13: metrics by column: all time before, the last weeks of the data, all time."""
    found = cohorts.matrix(cohorts.in_columns(_events(spark, folder), cohorts.week_number(F.col("ts")), COLUMNS), _users(spark, folder), COLUMNS)
    return found.select("metric", *[F.round(F.col(c), 9).alias(c) for c in found.columns[1:]])


def cohort_shares(spark: SparkSession, folder: str) -> DataFrame:
    """COH-10, COH-11: shares issued in a week, their answers by the shares' event ids, and the rates."""
    return _weekly(spark, folder).select("week", *cohorts.SHARES)


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """COH-12, DT-1: the last months of the data and what they hold, with what comes before and all time."""
    e = roles.table(spark, folder, "events").select("event_id", "ts")
    month = cohorts.month_number(F.col("ts"))
    last = e.agg(F.max(month).alias("last"))
    counts = cohorts.in_columns(e, month, COLUMNS).groupBy("bucket").agg(F.count("*").alias("events"))
    places = last.select("last", F.explode(F.array(*[F.lit(i) for i in (*range(-1, COLUMNS), cohorts.ALL_TIME)])).alias("bucket"))
    own = cohorts.month_label(F.col("last") - COLUMNS + 1 + F.greatest("bucket", F.lit(0)))
    label = F.when(F.col("bucket") == cohorts.ALL_TIME, "All Time").when(F.col("bucket") < 0, F.concat(F.lit("< "), own)).otherwise(own)
    return places.join(counts, "bucket", "left").select(label.alias("label"), F.coalesce("events", F.lit(0)).alias("events"))


def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type in windows of twelve hours, one every six."""
    e = roles.table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    found = e.groupBy(F.window("ts", "12 hours", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Users' sessions: events less than three hours apart belong together."""
    e = roles.table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = e.groupBy("user_id", F.session_window("ts", "3 hours")).agg(F.count("*").alias("events"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def error_tally(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-24, SRC-7: errors by provider and message, numbers taken out of the messages, with their first items."""
    e = roles.table(spark, folder, "events").filter("event_type = 'error'")
    key = F.get_json_object("props", "$.k").cast("int")
    message = F.regexp_replace(F.concat(F.lit("mailbox "), key.cast("string"), F.lit(" rejected")), r"\d+", "#")
    provider = F.when(key % 3 == 0, "alpha").when(key % 3 == 1, "beta").otherwise("gamma")
    return e.groupBy(provider.alias("provider"), message.alias("message")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.count_distinct("user_id").alias("users"))


def backoff(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-11, STM-7: when failed jobs run again: ten to the power of the attempts in seconds after the last job of the type, or after their own."""
    e = roles.table(spark, folder, "events").filter("event_type IN ('error', 'click')")
    last = e.groupBy("event_type").agg(F.max("ts").alias("last"))
    attempts = (F.col("event_id") % 4).cast("int")
    own = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pow(F.lit(10), attempts).cast("decimal(18,6)"))
    return e.join(last, "event_type").select("event_id", F.greatest(own, F.col("last")).alias("again"))


QUERIES = {f.__name__: f for f in (cohort_metrics, cohort_matrix, cohort_shares, calendar, sliding_windows, sessions, error_tally, backoff)}


def _rate(a: str, b: str) -> str:
    return f"{a} / nullif({b}, 0)"


_EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
cold AS (SELECT user_id, min(ts) AS ts FROM ev GROUP BY user_id HAVING NOT bool_or(kind = 'signup')),
al AS (SELECT event_id, ts, user_id, kind, k % 2 = 0 AS shared, event_id - k - 1 AS of_event FROM ev UNION ALL SELECT NULL, ts, user_id, 'cold', NULL, NULL FROM cold),
numbered AS (SELECT *, CAST(floor(date_diff('day', DATE '1970-01-04', CAST(ts AS DATE)) / 7) AS INTEGER) AS w FROM al)"""


def _metrics_sql(buckets: str, first: str) -> str:
    """Common table expressions up to m: all metrics by bucket. buckets: a query of the numbered events with their bucket."""
    kinds = {"accepted_invitations": "signup", "cold_signups": "cold", "invitations_issued": "click", "invitations_clicked": "purchase", "invitations_diverted": "error"}
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in kinds.items())
    answers = ", ".join(f"count(*) FILTER (a.kind = '{k}') AS {n}" for n, k in (("sc", "purchase"), ("sv", "signup"), ("sd", "error")))
    return f"""{_EVENTS}, e AS ({buckets}),
active AS (SELECT DISTINCT bucket, user_id FROM e WHERE kind = 'view' AND bucket < {cohorts.ALL_TIME}),
gone AS (SELECT a.bucket + 1 AS bucket, count(*) AS n FROM active a WHERE NOT EXISTS (SELECT 1 FROM active b WHERE b.bucket = a.bucket + 1 AND b.user_id = a.user_id) GROUP BY 1),
answered AS (SELECT s.bucket, {answers} FROM e s JOIN e a ON a.of_event = s.event_id AND a.bucket = s.bucket WHERE s.kind = 'click' AND s.shared GROUP BY s.bucket),
per AS (SELECT bucket, count(DISTINCT user_id) FILTER (kind = 'view') AS active_users, count(*) FILTER (kind = 'view') AS logins, {counts}, count(*) FILTER (kind = 'click' AND shared) AS shares_issued FROM e GROUP BY bucket),
plain AS (SELECT per.*, CASE WHEN bucket > {first} AND bucket < {cohorts.ALL_TIME} THEN coalesce(gone.n, 0) END AS dropouts, accepted_invitations + cold_signups AS new_users, accepted_invitations AS invitations_converted,
  coalesce(sc, 0) AS shares_clicked, coalesce(sv, 0) AS shares_converted, coalesce(sd, 0) AS shares_diverted FROM per LEFT JOIN gone USING (bucket) LEFT JOIN answered USING (bucket)),
m AS (SELECT *, {_rate("logins", "active_users")} AS sessions_per_active_user, new_users - dropouts AS net_new_users, accepted_invitations / (SELECT count(*) FROM customer) AS viral_coefficient,
  {_rate("invitations_clicked", "invitations_issued")} AS invitation_click_rate, {_rate("invitations_converted", "invitations_issued")} AS invitation_conversion_rate,
  {_rate("invitations_converted", "invitations_clicked")} AS invitation_response_conversion_rate, {_rate("shares_clicked", "shares_issued")} AS share_click_rate,
  {_rate("shares_converted", "shares_issued")} AS share_conversion_rate, {_rate("shares_converted", "shares_clicked")} AS share_response_conversion_rate FROM plain)"""


_WEEKLY_SQL = f"WITH {_metrics_sql('SELECT *, w AS bucket FROM numbered', '(SELECT min(bucket) FROM per)')}, d AS (SELECT *, DATE '1970-01-04' + 7 * bucket AS week FROM m)"
_PLACES = f"SELECT *, unnest([greatest(-1, w - (SELECT max(w) FROM numbered) + {COLUMNS - 1}), {cohorts.ALL_TIME}]) AS bucket FROM numbered"
_LONG = " UNION ALL ".join(f"SELECT bucket, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM m" for m in cohorts.METRICS)
_NAMES = {-1: "before", **{i: f"i{i}" for i in range(COLUMNS)}, cohorts.ALL_TIME: "all_time"}
ORACLE_SQL = {
    "cohort_metrics": f"{_WEEKLY_SQL} SELECT week, {', '.join(cohorts.METRICS)} FROM d",
    "cohort_matrix": f"WITH {_metrics_sql(_PLACES, '-1')}, l AS ({_LONG}) SELECT metric, " + ", ".join(f"round(max(value) FILTER (bucket = {b}), 9) AS {n}" for b, n in _NAMES.items()) + " FROM l GROUP BY metric",
    "cohort_shares": f"{_WEEKLY_SQL} SELECT week, {', '.join(cohorts.SHARES)} FROM d",
    "calendar": f"""WITH e AS (SELECT year(ts) * 12 + month(ts) - 1 AS m FROM events), z AS (SELECT max(m) AS last FROM e),
n AS (SELECT last, unnest(range(last - {COLUMNS - 1}, last + 1)) AS m FROM z), l AS (SELECT n.m, last, CAST(n.m % 12 + 1 AS VARCHAR) || '/' || substr(CAST(n.m // 12 AS VARCHAR), 3, 2) AS label FROM n)
SELECT label, (SELECT count(*) FROM e WHERE e.m = l.m) AS events FROM l
UNION ALL SELECT '< ' || label, (SELECT count(*) FROM e WHERE e.m < l.m) FROM l WHERE l.m = last - {COLUMNS - 1} UNION ALL SELECT 'All Time', count(*) FROM events""",
    "sliding_windows": """SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS s FROM events) GROUP BY s, event_type""",
    "sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
c AS (SELECT user_id, n, count(*) AS events FROM s GROUP BY user_id, n) SELECT user_id, count(*) AS sessions, max(events) AS longest FROM c GROUP BY user_id""",
    "error_tally": """SELECT CASE k % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider, 'mailbox # rejected' AS message, count(*) AS n, min(event_id) AS first_id, count(DISTINCT user_id) AS users
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error') GROUP BY 1, 2""",
    "backoff": """SELECT event_id, greatest(ts + to_seconds(CAST(pow(10, event_id % 4) AS INTEGER)), max(ts) OVER (PARTITION BY event_type)) AS again FROM events WHERE event_type IN ('error', 'click')""",
}

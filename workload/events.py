"""Registers, rankings and checks on the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.payload import json_default, parse_strict, text_at
from runledger.functions.times import (
    event_time, iso_local, local_time, minutes_between, or_minutes, parse_local_ts, valid_minutes,
)
from runledger.operators.chunks import paged_arrays, positions
from runledger.operators.pairs import span_pairs as pairs
from runledger.operators.quality import classify_failure, event_lists, events_by_phase, stalled_jobs
from runledger.operators.ranking import argmax_first, first_rows, last_wins, passing_keys, tail_rows
from runledger.operators.registers import Register, with_registers
from workload.registry import query, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _is(*types: str):
    return F.col("event_type").isin(*types)


def _span_columns(spans: DataFrame) -> DataFrame:
    return spans.select("user_id", "start_seq", "end_seq", F.round("minutes", 9).alias("minutes"))


def _pairs_sql(clear: str) -> str:
    return f"""
WITH e AS (
  SELECT user_id, event_id, ts, event_type,
         nullif(last_value(CASE WHEN event_type = 'signup' THEN event_id {clear} END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS held
  FROM events),
ends AS (
  SELECT user_id, held, max(event_id) AS end_seq, max(ts) AS end_ts
  FROM e WHERE event_type = 'purchase' AND held IS NOT NULL GROUP BY 1, 2)
SELECT s.user_id, s.event_id AS start_seq, n.end_seq,
       round((epoch_us(n.end_ts) - epoch_us(s.ts)) / 6e7, 9) AS minutes
FROM e s LEFT JOIN ends n ON n.user_id = s.user_id AND n.held = s.event_id
WHERE s.event_type = 'signup'"""


@query(_pairs_sql("WHEN event_type = 'purchase' THEN -1"))
def span_pairs(spark, sf):
    spans = pairs(_events(spark, sf), ["user_id"], "event_id", "ts", _is("signup"), _is("purchase"))
    return _span_columns(spans)


@query(_pairs_sql(""))
def span_pairs_sticky(spark, sf):
    spans = pairs(_events(spark, sf), ["user_id"], "event_id", "ts", _is("signup"), _is("purchase"), clears=False)
    return _span_columns(spans)


@query(_pairs_sql("WHEN event_type = 'purchase' THEN -1"))
def span_pairs_split(spark, sf):
    """The same spans with every user's rows cut into chunks."""
    spans = pairs(
        _events(spark, sf), ["user_id"], "event_id", "ts", _is("signup"), _is("purchase"), max_rows=12
    )
    return _span_columns(spans)


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions from signup to purchase, views within them closed by clicks, errors within those."""
    passes = [
        lambda _: {"session": Register(_is("signup"), F.col("event_id"), _is("purchase"))},
        lambda _: {"view": Register(_is("view") & F.col("session").isNotNull(), F.col("event_id"), _is("click"))},
    ]
    return with_registers(_events(spark, sf).drop("props", "value"), passes, ["user_id"], ["event_id"])


_NESTED_SQL = """
WITH a AS (
  SELECT user_id, event_id, ts, event_type,
         nullif(last_value(CASE event_type WHEN 'signup' THEN event_id WHEN 'purchase' THEN -1 END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS session
  FROM events),
b AS (
  SELECT *,
         nullif(last_value(CASE WHEN event_type = 'view' AND session IS NOT NULL THEN event_id
                                WHEN event_type = 'click' THEN -1 END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS vw
  FROM a)"""


@query(_NESTED_SQL + """,
clicks AS (SELECT user_id, vw, max(event_id) AS end_seq, max(ts) AS end_ts FROM b
           WHERE event_type = 'click' AND vw IS NOT NULL GROUP BY 1, 2),
errors AS (SELECT user_id, vw, count(*) AS n FROM b WHERE event_type = 'error' AND vw IS NOT NULL GROUP BY 1, 2)
SELECT v.user_id, v.session AS parent_seq, v.event_id AS start_seq, c.end_seq,
       round((epoch_us(c.end_ts) - epoch_us(v.ts)) / 6e7, 9) AS minutes, coalesce(e.n, 0) AS errors
FROM b v LEFT JOIN clicks c ON c.user_id = v.user_id AND c.vw = v.event_id
LEFT JOIN errors e ON e.user_id = v.user_id AND e.vw = v.event_id
WHERE v.event_type = 'view' AND v.session IS NOT NULL""")
def nested_spans(spark, sf):
    tracked = _nested(spark, sf)
    opens = _is("view") & F.col("session").isNotNull()
    held = F.when(opens, F.col("event_id")).otherwise(F.col("view"))
    rows = tracked.where(opens | (_is("click", "error") & F.col("view").isNotNull()))
    seq, click = F.col("event_id"), _is("click")
    spans = rows.groupBy("user_id", held.alias("start_seq")).agg(
        F.max(F.when(opens, F.col("session"))).alias("parent_seq"),
        F.max(F.when(opens, F.col("ts"))).alias("start_ts"),
        F.max(F.when(click, seq)).alias("end_seq"),
        F.max(F.when(click, F.col("ts"))).alias("end_ts"),
        F.count_if(_is("error")).alias("errors"),
    )
    minutes = F.round(minutes_between(F.col("start_ts"), F.col("end_ts")), 9).alias("minutes")
    return spans.select("user_id", "parent_seq", "start_seq", "end_seq", minutes, "errors")


@query(_NESTED_SQL + """
SELECT event_type,
       count(*) FILTER (WHERE event_type = 'view' AND session IS NULL) AS refused_starts,
       count(*) FILTER (WHERE (event_type = 'purchase' AND session IS NULL)
                           OR (event_type IN ('click', 'error') AND vw IS NULL)) AS unmatched_ends
FROM b GROUP BY 1""")
def orphan_events(spark, sf):
    refused = _is("view") & F.col("session").isNull()
    unmatched = (_is("purchase") & F.col("session").isNull()) | (_is("click", "error") & F.col("view").isNull())
    return _nested(spark, sf).groupBy("event_type").agg(
        F.count_if(refused).alias("refused_starts"), F.count_if(unmatched).alias("unmatched_ends")
    )


# A reported duration: absent, zero, huge or negative by kind of event.
_RAW_SQL = """CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 0.0 WHEN 'signup' THEN value * 10
              WHEN 'purchase' THEN -value ELSE value END"""


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the start of the span each one ends: the user's signup before it."""
    rows = _events(spark, sf).withColumn("raw", F.expr(_RAW_SQL).cast("string"))
    register = {"start": Register(_is("signup"), F.col("ts"))}
    return with_registers(rows, [lambda _: register], ["user_id"], ["event_id"])


def _minutes_sql(valid: bool) -> str:
    test = "raw IS NOT NULL AND raw BETWEEN 0 AND 1440" if valid else "raw IS NOT NULL AND raw <> 0"
    return f"""
WITH r AS (
  SELECT event_id, ts, {_RAW_SQL} AS raw,
         last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
  FROM events)
SELECT event_id, round(CASE WHEN {test} THEN raw
                            ELSE greatest(0.0, coalesce((epoch_us(ts) - epoch_us(start)) / 6e7, 0.0)) END, 9) AS minutes
FROM r"""


@query(_minutes_sql(True))
def reported_minutes(spark, sf):
    minutes = valid_minutes(F.col("raw"), F.col("start"), F.col("ts"))
    return _reported(spark, sf).select("event_id", F.round(minutes, 9).alias("minutes"))


@query(_minutes_sql(False))
def nonzero_minutes(spark, sf):
    minutes = or_minutes(F.col("raw"), F.col("start"), F.col("ts"))
    return _reported(spark, sf).select("event_id", F.round(minutes, 9).alias("minutes"))


@query("""
SELECT event_id, strftime(CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-15 17:30:00' ELSE ts END, '%Y-%m-%d %H:%M:%S') AS at
FROM events""")
def event_times_or_read(spark, sf):
    """Events whose time cannot be read get the time of reading, a fixed instant here, in the log's zone."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    broken = F.when(_is("error"), F.concat(text, F.lit("x"))).otherwise(text)
    read = local_time(F.timestamp_seconds(F.lit(1705320000)))
    at = event_time(parse_local_ts(broken), read)
    return _events(spark, sf).select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS iso,
       CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' END AS parsed,
       round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 6e7, 9) AS minutes
FROM events""")
def event_times(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    broken = F.when(_is("error"), F.concat(text, F.lit("x"))).otherwise(text)
    since = F.expr("timestamp_ntz'2024-01-15 12:00:00'")
    return _events(spark, sf).select(
        "event_id",
        iso_local(F.col("ts")).alias("iso"),
        iso_local(parse_local_ts(broken)).alias("parsed"),
        F.round(minutes_between(since, F.col("ts")), 9).alias("minutes"),
    )


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'none' AS absent
FROM events""")
def json_fields(spark, sf):
    rows = _events(spark, sf).withColumn("v", parse_strict(F.col("props")))
    return rows.select(
        "event_id", text_at(F.col("v"), "$.k").try_cast("int").alias("k"), json_default(F.col("v"), "$.zz", "none").alias("absent")
    )


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_type(spark, sf):
    return events_by_phase(_events(spark, sf), ["user_id"], "event_type")


@query("""
SELECT user_id, 0 AS page, CAST(count(*) AS INTEGER) AS n, string_agg(event_type, ',' ORDER BY event_id) AS names
FROM events GROUP BY 1""")
def event_names_in_order(spark, sf):
    lists = event_lists(_events(spark, sf), ["user_id"], "event_id", "event_type")
    return lists.select("user_id", "page", "n", F.array_join("event_type", ",").alias("names"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos FROM events")
def event_positions(spark, sf):
    """Rank within a few very heavy keys, computed in chunks of rows."""
    rows = _events(spark, sf).select("event_id", "event_type")
    return positions(rows, ["event_type"], ["event_id"], max_rows=512)


@query("""
SELECT user_id, event_id, event_type, score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn
  FROM (SELECT user_id, event_id, event_type, floor(value) AS score FROM events) WHERE score > -1) WHERE rn = 1""")
def best_event_per_user(spark, sf):
    rows = _events(spark, sf).select("user_id", "event_id", "event_type", F.floor("value").cast("double").alias("score"))
    return argmax_first(rows, ["user_id"], "score", ["event_id"])


@query("""
WITH best AS (SELECT user_id, event_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn
  FROM (SELECT user_id, event_id, floor(value / 10) AS score FROM events) WHERE score > -1) WHERE rn = 1)
SELECT cohort, user_id, event_id, score FROM (
  SELECT CAST(user_id // 10 AS BIGINT) AS cohort, *,
         row_number() OVER (PARTITION BY user_id // 10 ORDER BY score DESC, event_id) AS rn FROM best) WHERE rn = 1""")
def best_user_per_cohort(spark, sf):
    score = F.floor(F.col("value") / 10).cast("double")
    rows = _events(spark, sf).select("user_id", "event_id", score.alias("score"))
    best = argmax_first(rows, ["user_id"], "score", ["event_id"])
    cohort = F.floor(F.col("user_id") / 10).alias("cohort")
    return argmax_first(best.select("*", cohort), ["cohort"], "score", ["event_id"])


@query("""
SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def slots_last_wins(spark, sf):
    rows = _events(spark, sf).select("user_id", "event_type", "event_id")
    return last_wins(rows, ["user_id", "event_type"], ["event_id"])


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS k FROM events),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
                     FROM e WHERE event_type = 'view' AND value > -1) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS rn
                     FROM e WHERE event_type = 'click') WHERE rn = 1)
SELECT v.user_id, v.event_id AS view_id, c.event_id AS click_id, v.value, c.value AS click_value
FROM v JOIN c ON c.user_id = v.user_id AND c.k = v.k""")
def paired_rows(spark, sf):
    """Best view of each user with the user's first click of the same kind."""
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("k")
    rows = _events(spark, sf).select("user_id", "event_id", "event_type", "value", k)
    views = argmax_first(rows.where(_is("view")), ["user_id"], "value", ["event_id"])
    clicks = first_rows(rows.where(_is("click")), ["user_id", "k"], ["event_id"])
    firsts = clicks.select("user_id", "k", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    joined = views.join(firsts, ["user_id", "k"])
    return joined.select("user_id", F.col("event_id").alias("view_id"), "click_id", "value", "click_value")


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_and(value < 300)")
def gated_users(spark, sf):
    return passing_keys(_events(spark, sf), ["user_id"], F.col("value") < 300)


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 50""")
def tail_n(spark, sf):
    return tail_rows(_events(spark, sf).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("""
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
           WHERE rn <= 5),
f AS (SELECT user_id, bool_or((event_type = 'error' AND value > 20) OR event_type = 'purchase') AS bad FROM t GROUP BY 1)
SELECT c.c_custkey AS user_id,
       CASE WHEN f.bad IS NULL THEN 'Training script stopped and no log file found'
            WHEN f.bad THEN 'Training script failed - check logs for details'
            ELSE 'Training script stopped unexpectedly' END AS message
FROM customer c LEFT JOIN f ON f.user_id = c.c_custkey""")
def failure_messages(spark, sf):
    line = F.when(_is("error") & (F.col("value") > 20), "Error: x").when(_is("purchase"), "step FAILED").otherwise("ok")
    lines = _events(spark, sf).select("user_id", "event_id", line.alias("line"))
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return classify_failure(jobs, lines, "user_id", "event_id", "line", 5)


@query("""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, 'Training script stopped without producing logs' AS message
FROM events GROUP BY 1
HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1440 MINUTE
   AND NOT bool_or(event_type = 'purchase' AND value > 90)""")
def stalled_users(spark, sf):
    ended = "event_type = 'purchase' AND value > 90"
    stalled = stalled_jobs(_events(spark, sf), "2024-01-31 00:00:00", 1440, "user_id", "ts", ended)
    return stalled.select("user_id", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "message")


@query("""
SELECT l_orderkey, 0 AS page, CAST(count(*) AS INTEGER) AS n,
       string_agg(CASE WHEN l_discount = 0 THEN '-' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END, ','
                  ORDER BY l_linenumber, l_extendedprice, l_partkey) AS discounts
FROM lineitem GROUP BY 1""")
def ordered_arrays(spark, sf):
    """Discounts of each order by line number; a discount of zero is a null in the array."""
    percent = F.round(F.col("l_discount") * 100).cast("long")
    rows = table(spark, sf, "lineitem").withColumn("discount", F.when(F.col("l_discount") != 0, percent))
    order = ["l_linenumber", "l_extendedprice", "l_partkey"]
    pages = paged_arrays(rows, ["l_orderkey"], order, ["discount"])
    return pages.select("l_orderkey", "page", "n", F.array_join(F.col("discount").cast("array<string>"), ",", "-").alias("discounts"))



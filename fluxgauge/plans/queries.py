"""Queries of the analytics operators over the driver's tables, each with its SQL.

Roles: a user is a sensor, an event a reading, its type the class; props.k is a second channel.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.windows import Series
from ..operators import checks, coverage, dataset, detect, features, inject, kalman, labels, placement, rules, sketches, spans, splits, stats, store, studies, views
from ..sources import archive, readings
from ..streaming import windows as stream

S = Series(("sensor",), ("ts", "event_id"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EVENTS = """(SELECT user_id AS sensor, ts, event_id, event_type AS kind, value AS v,
  cast(json_extract(props, '$.k') AS DOUBLE) AS k, epoch_us(ts) / 1e6 AS s FROM events)"""
W = "PARTITION BY sensor ORDER BY ts, event_id"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r(x: Column) -> Column:
    """To seven places, without a negative zero: sums of numbers with two places have no ties there."""
    return F.round(x, 7) + F.lit(0.0)


def rs(x: str) -> str:
    return f"(round({x}, 7) + 0.0)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY sensor ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sensor"), "ts", "event_id", F.col("event_type").alias("kind"),
        scalar.clean(F.col("value")).alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"),
    )


def spans_of(e: DataFrame) -> DataFrame:
    """Spans from clicks alone, as if they were the normal run; envelopes so are often left."""
    return spans.derive(e.where("kind = 'click' AND v < 60"), "sensor", "v")


SPANS = """(SELECT sensor, round(a - 2.0 * w, 6) AS low, round(b + 2.0 * w, 6) AS high, round(a - 0.2 * w, 6) AS alarm_low,
  round(b + 0.2 * w, 6) AS alarm_high FROM (SELECT sensor, a, b, CASE WHEN b > a THEN b - a ELSE 1.0 END AS w FROM (
  SELECT sensor, min(v) AS a, max(v) AS b FROM e WHERE kind = 'click' AND v < 60 GROUP BY sensor)))"""


# --- Windows.


def _rolling(n: int):
    def run(spark, sf_dir):
        x = F.col("v")
        cols = {"mean": S.mean(x, n), "std": S.std(x, n), "low": S.min(x, n), "high": S.max(x, n)}
        return events(spark, sf_dir).select("event_id", *[r(c).alias(k) for k, c in cols.items()])

    run.__name__ = f"roll_stats_{n}"
    fs = {"mean": "avg", "std": "stddev_samp", "low": "min", "high": "max"}
    cols = ", ".join(f"CASE WHEN count(v) {frame(n)} >= 3 THEN {rs(f'{f}(v) {frame(n)}')} END AS {k}" for k, f in fs.items())
    query(f"SELECT event_id, {cols} FROM {EVENTS}")(run)


for _n in (10, 20, 60):
    _rolling(_n)


@query(f"SELECT event_id, {', '.join(f'lag(v, {k}) OVER ({W}) AS lag_{k}' for k in range(1, 6))} FROM {EVENTS}")
def lags_1_5(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *[S.lag(F.col("v"), k).alias(f"lag_{k}") for k in range(1, 6)])


@query(
    f"""SELECT event_id, {rs(f'(v - lag(v) OVER ({W})) / 180.0')} AS change,
  CASE WHEN s - lag(s) OVER ({W}) > 0 THEN {rs(f'(v - lag(v) OVER ({W})) / (s - lag(s) OVER ({W}))')} END AS rate FROM {EVENTS}"""
)
def rate_of_change(spark, sf_dir):
    x = F.col("v")
    return events(spark, sf_dir).select("event_id", r(S.change(x, 180.0)).alias("change"), r(S.rate(x, F.col("s"))).alias("rate"))


@query(
    f"""SELECT event_id, {rs(f"coalesce(CASE WHEN count(v) {frame(10)} > 1 THEN regr_slope(v, rn) {frame(10)} END, 0.0) / 180.0")} AS slope
  FROM (SELECT *, cast(row_number() OVER ({W}) AS DOUBLE) AS rn FROM {EVENTS})"""
)
def slope_10(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r(S.slope(F.col("v"), 10, 180.0)).alias("slope"))


@query(
    f"""SELECT event_id, CASE WHEN len(d) < 2 THEN 0.0 ELSE {rs("len(list_filter(range(1, len(d)), lambda i: d[i] <> d[i + 1])) / (len(d) - 1)")} END AS zcr
  FROM (SELECT event_id, list_filter(list_transform(l, lambda x: sign(x - m)), lambda g: g <> 0) AS d FROM (
    SELECT event_id, list(v) {frame(10)} AS l, avg(v) {frame(10)} AS m FROM {EVENTS}))"""
)
def zcr_10(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r(S.zero_crossings(F.col("v"), 10)).alias("zcr"))


@query(
    f"""SELECT event_id, {rs("CASE WHEN b > 0 THEN a / b END")} AS ratio FROM (SELECT event_id,
  CASE WHEN count(v) {frame(10)} >= 3 THEN stddev_samp(v) {frame(10)} END AS a,
  CASE WHEN count(v) {frame(60)} >= 3 THEN stddev_samp(v) {frame(60)} END AS b FROM {EVENTS})"""
)
def variance_ratio(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r(S.variance_ratio(F.col("v"), 10, 60)).alias("ratio"))


RUNS = f"""(SELECT *, row_number() OVER (PARTITION BY sensor, g ORDER BY ts, event_id) AS run FROM (
  SELECT *, sum(b) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, CASE WHEN x = lag(x) OVER ({W}) THEN 0 ELSE 1 END AS b FROM (SELECT *, floor(v / 40.0) AS x FROM {EVENTS}))))"""


def _runs(e: DataFrame) -> DataFrame:
    return detect.run_length(e.withColumn("x", F.floor(F.col("v") / 40.0).cast("double")), S, "x")


@query(f"SELECT event_id, cast(run AS BIGINT) AS run FROM {RUNS}")
def stuck_run_length(spark, sf_dir):
    return _runs(events(spark, sf_dir)).select("event_id", F.col("run").cast("bigint").alias("run"))


@query(f"SELECT sensor, cast(max(run) AS BIGINT) AS longest FROM {RUNS} GROUP BY sensor")
def longest_run(spark, sf_dir):
    return _runs(events(spark, sf_dir)).groupBy("sensor").agg(F.max("run").cast("bigint").alias("longest"))


@query(
    f"""WITH e AS (SELECT *, row_number() OVER ({W}) - 1 AS step FROM {EVENTS}), i AS (SELECT step, max(CASE WHEN sensor = 1 THEN v END) AS x,
  max(CASE WHEN sensor = 2 THEN v END) AS y FROM e GROUP BY step), c AS (SELECT step, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) OVER w AS n,
  covar_samp(x, y) OVER w AS c, stddev_samp(CASE WHEN y IS NOT NULL THEN x END) OVER w * stddev_samp(CASE WHEN x IS NOT NULL THEN y END) OVER w AS p
  FROM i WINDOW w AS (ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT event_id, CASE WHEN n >= 3 AND p > 0 THEN {rs("c / p")} END AS corr FROM e JOIN c USING (step)"""
)
def pair_corr_10(spark, sf_dir):
    """Two sensors' correlation over their last ten instants, at every reading of the instant."""
    rows = steps(events(spark, sf_dir)).withColumns({"run": F.lit(0), "__x": F.col("v")})
    found = features.instants(rows, "run", "sensor", "step", 1, 2)
    found = found.select("step", r(Series(("run",), ("step",)).pair_correlation(F.col("__a"), F.col("__b"), 10)).alias("corr"))
    return rows.join(found, "step").select("event_id", "corr")


@query(
    f"""SELECT event_id, cast(hour(ts) AS BIGINT) AS hour_of_day, cast(isodow(ts) - 1 AS BIGINT) AS day_of_week,
  {rs("avg(CASE WHEN kind = 'purchase' THEN v END) OVER (PARTITION BY date_trunc('hour', ts))")} AS level FROM {EVENTS}"""
)
def context_features(spark, sf_dir):
    e = events(spark, sf_dir)
    t = F.col("ts").cast("timestamp")
    level = F.avg(F.when(F.col("kind") == "purchase", F.col("v"))).over(Window.partitionBy(F.date_trunc("hour", t)))
    return e.select("event_id", F.hour(t).cast("bigint").alias("hour_of_day"), F.weekday(t).cast("bigint").alias("day_of_week"), r(level).alias("level"))


@query(
    f"""SELECT event_id, last_value(g IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried,
  {rs(f"s - last_value(CASE WHEN g IS NOT NULL THEN s END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")} AS since
  FROM (SELECT *, CASE WHEN kind <> 'click' THEN v END AS g FROM {EVENTS})"""
)
def carry_forward(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("g", F.when(F.col("kind") != "click", F.col("v")))
    return e.select("event_id", S.carried(F.col("g")).alias("carried"), r(S.since_valid(F.col("g"), F.col("s"))).alias("since"))


# --- Splits and timelines.

SPLIT = """(SELECT *, CASE WHEN rk < floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN rk < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS rk, nd AS n FROM events
  JOIN (SELECT event_type, count(DISTINCT ts) AS nd FROM events GROUP BY event_type) USING (event_type)))"""


def _split(spark, sf_dir):
    return splits.temporal_split(read(spark, sf_dir, "events"), ["event_type"], "ts")


@query(f"SELECT event_id, split FROM {SPLIT}")
def temporal_split(spark, sf_dir):
    return _split(spark, sf_dir).select("event_id", "split")


@query(
    f"""SELECT split, count(*) AS n_rows, {rs("count(*) / (SELECT count(*) FROM events)")} AS share, min(ts) AS first_step,
  max(ts) AS last_step FROM {SPLIT} GROUP BY split"""
)
def split_metrics(spark, sf_dir):
    return splits.metrics(_split(spark, sf_dir), "ts").withColumn("share", r(F.col("share")))


@query(
    f"""SELECT event_type, max(CASE WHEN split = 'train' THEN ts END) < min(CASE WHEN split = 'validation' THEN ts END)
  AND max(CASE WHEN split = 'validation' THEN ts END) < min(CASE WHEN split = 'test' THEN ts END) AS holds FROM {SPLIT} GROUP BY event_type"""
)
def split_order(spark, sf_dir):
    return splits.order_holds(_split(spark, sf_dir), ["event_type"], "ts")


@query(
    f"""SELECT event_type, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'validation' THEN 1 END) AS validation,
  count(CASE WHEN split = 'test' THEN 1 END) AS test FROM {SPLIT} GROUP BY event_type"""
)
def split_distribution(spark, sf_dir):
    n = {s: F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")}
    return _split(spark, sf_dir).groupBy("event_type").agg(*n.values())


@query(
    """SELECT user_id, n AS n_steps, cast(coalesce(sum(n + 1) OVER (ORDER BY length(cast(user_id AS VARCHAR)), cast(user_id AS VARCHAR)
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"""
)
def class_timeline(spark, sf_dir):
    runs = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run")).agg(F.count("*").alias("n_steps"))
    return store.end_to_end(runs, "run", "n_steps").select(F.col("run").cast("bigint").alias("user_id"), "n_steps", "offset")


@query(
    """SELECT event_id, epoch_us(ts) + (SELECT epoch_us(TIMESTAMP '2030-01-01 00:00:00') - max(epoch_us(ts)) FROM events) AS micros FROM events"""
)
def rebase_timeline(spark, sf_dir):
    moved = store.rebased(read(spark, sf_dir, "events"), "ts", "2030-01-01 00:00:00")
    return moved.select("event_id", F.unix_micros("ts").alias("micros"))


# --- Statistics.


@query(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, {rs(f'avg({c})')} AS mean, {rs(f'stddev_samp({c})')} AS std, "
        f"cast(min({c}) AS DOUBLE) AS low, cast(max({c}) AS DOUBLE) AS high FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    )
)
def describe_columns(spark, sf_dir):
    got = stats.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return got.withColumns({c: r(F.col(c)) for c in ("mean", "std")})


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rs(f'corr({a}, {b})')} AS r FROM lineitem" for a in _COLS for b in _COLS))
def corr_matrix(spark, sf_dir):
    return stats.correlations(read(spark, sf_dir, "lineitem"), list(_COLS)).withColumn("r", r(F.col("r")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_class(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH e AS {EVENTS} SELECT * FROM {SPANS}")
def derive_spans(spark, sf_dir):
    return spans_of(events(spark, sf_dir))


@query(
    f"""WITH e AS {EVENTS} SELECT event_id, CASE WHEN v - low IS NOT NULL THEN cast(floor(least(greatest((v - low) * 65535.0 / (high - low), 0.0), 65535.0)) AS INTEGER) END AS counts
  FROM e LEFT JOIN {SPANS} USING (sensor)"""
)
def adc_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    return spans.attach(e, spans_of(e), "sensor").select("event_id", spans.counts(F.col("v")).alias("counts"))


@query(
    f"""WITH e AS {EVENTS} SELECT event_id, v BETWEEN low AND high AS in_span, v BETWEEN alarm_low AND alarm_high AS in_envelope
  FROM e LEFT JOIN {SPANS} USING (sensor)"""
)
def envelope_flags(spark, sf_dir):
    e = events(spark, sf_dir)
    return spans.attach(e, spans_of(e), "sensor").select(
        "event_id", spans.in_span(F.col("v")).alias("in_span"), spans.in_envelope(F.col("v")).alias("in_envelope")
    )


@query(f"WITH e AS {EVENTS} SELECT DISTINCT sensor FROM e WHERE sensor NOT IN (SELECT sensor FROM {SPANS})")
def uncovered_sensors(spark, sf_dir):
    e = events(spark, sf_dir)
    return spans.uncovered(e, spans_of(e), "sensor")


@query(
    f"""SELECT sensor, {rs("quantile_cont(v, 0.5)")} AS p50, {rs("quantile_cont(v, 0.95)")} AS p95, {rs("quantile_cont(v, 0.99)")} AS p99
  FROM {EVENTS} GROUP BY sensor"""
)
def percentiles(spark, sf_dir):
    p = F.percentile("v", [0.5, 0.95, 0.99])
    got = events(spark, sf_dir).groupBy("sensor").agg(p.alias("p"))
    return got.select("sensor", *[r(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


# --- Contract and checks.


@query("SELECT event_id, event_type NOT IN ('error', 'signup') AS usable FROM events")
def usable_filter(spark, sf_dir):
    quality = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "signup", "missing").otherwise("good")
    return read(spark, sf_dir, "events").select("event_id", checks.usable(quality).alias("usable"))


@query(
    """SELECT event_id, rule FROM (SELECT event_id, CASE WHEN NOT value BETWEEN 0 AND 100 THEN 'value' END AS rule FROM events
  UNION ALL SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'kind' END FROM events
  UNION ALL SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'sensor' END FROM events) WHERE rule IS NOT NULL"""
)
def contract_violations(spark, sf_dir):
    conditions = {
        "value": F.col("value").between(0, 100),
        "kind": F.col("event_type").isin("click", "view", "purchase"),
        "sensor": F.col("user_id") % 2 == 0,
    }
    return checks.violations(read(spark, sf_dir, "events"), conditions, ["event_id"])


@query(
    f"""SELECT sensor, count(*) AS n, count(DISTINCT gap) AS n_gaps, min(gap) AS least, max(gap) AS most FROM (
  SELECT sensor, epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) AS gap FROM {EVENTS}) GROUP BY sensor"""
)
def cadence_check(spark, sf_dir):
    return checks.cadence(events(spark, sf_dir), ["sensor"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    """SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*)
  AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey"""
)
def contiguity_check(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("step", F.col("l_linenumber") - 1)
    return checks.contiguous(lines, ["l_orderkey"], "step")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return checks.repeated(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, lag(l_suppkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem) WHERE before > l_suppkey"""
)
def backward_steps(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    back = checks.backwards(read(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "l_suppkey")
    return back.select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    """SELECT event_id, cast(props AS VARCHAR) LIKE '{"k": 1%' AS tombstone, (event_id % 7 = 0) AS poison,
  CASE WHEN event_id % 7 = 0 OR props LIKE '{"k": 1%' THEN NULL ELSE cast(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events"""
)
def poison_split(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("tombstone", F.col("props").startswith('{"k": 1'))
    text = F.when(F.col("tombstone"), F.lit(None)).when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    parsed = F.from_json(text, "k bigint", {"mode": "PERMISSIVE"})
    return e.select("event_id", "tombstone", (F.col("event_id") % 7 == 0).alias("poison"), parsed["k"].cast("double").alias("k"))


# --- Shapes.


@query(
    "\nUNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS channel, cast({c} AS DOUBLE) AS value FROM lineitem" for c in _COLS
    )
)
def unpivot_long(spark, sf_dir):
    return stats.unpivot(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], list(_COLS))


_KINDS = ("click", "view", "purchase")


@query(f"SELECT sensor, {', '.join(rs(f'avg(CASE WHEN kind = {k!r} THEN v END)') + f' AS {k}' for k in _KINDS)} FROM {EVENTS} GROUP BY sensor")
def pivot_wide(spark, sf_dir):
    got = stats.wide(events(spark, sf_dir), ["sensor"], "kind", "v", list(_KINDS))
    return got.select("sensor", *[r(F.col(k)).alias(k) for k in _KINDS])


# --- Detectors.


def _fault_columns(fault: Column) -> list[Column]:
    names = ("fault_type", "severity", "confidence", "magnitude")
    return [(r(fault[n]) if n in names[2:] else fault[n]).alias(n) for n in names]


def _confidence(m: str, t: str, s: float) -> str:
    return f"least(1.0, 0.5 + 0.5 * greatest(({m} / ({t}) - 1.0) / {s - 1}, 0.0))"


@query(
    f"""SELECT event_id, 'stuck' AS fault_type, CASE WHEN run / 3.0 >= 4 THEN 'critical' WHEN run / 3.0 >= 2 THEN 'high' ELSE 'medium' END AS severity,
  {rs(_confidence("run", "3.0", 3.0))} AS confidence, cast(run AS DOUBLE) AS magnitude FROM {RUNS} WHERE run >= 3"""
)
def detect_stuck(spark, sf_dir):
    e = _runs(events(spark, sf_dir)).withColumn("f", detect.stuck(F.col("run"), 3)).where("f IS NOT NULL")
    return e.select("event_id", *_fault_columns(F.col("f")))


@query(
    f"""WITH e AS {EVENTS} SELECT event_id, 'noise_spike' AS fault_type, CASE WHEN rate > 5 * 0.00001 THEN 'high' ELSE 'medium' END AS severity,
  {rs(_confidence("rate", "0.00001", 5.0))} AS confidence, {rs("rate")} AS magnitude FROM (SELECT event_id,
  CASE WHEN s - ls > 0 AND alarm_high > alarm_low THEN abs(v - lv) / ((alarm_high - alarm_low) * (s - ls)) END AS rate FROM (
  SELECT *, lag(s) OVER ({W}) AS ls, lag(v) OVER ({W}) AS lv FROM e) LEFT JOIN {SPANS} USING (sensor)) WHERE rate > 0.00001"""
)
def detect_rate(spark, sf_dir):
    e = events(spark, sf_dir)
    e = spans.attach(e, spans_of(e), "sensor").withColumn("f", detect.spike(S, F.col("v"), F.col("s"), 1e-5)).where("f IS NOT NULL")
    return e.select("event_id", *_fault_columns(F.col("f")))


@query(
    f"""WITH e AS {EVENTS} SELECT event_id, 'bias_out_of_range' AS fault_type, CASE WHEN v < low OR v > high THEN 'critical'
  WHEN x > 0.25 * w THEN 'high' ELSE 'medium' END AS severity, {rs(_confidence("(x + w)", "w", 2.0))} AS confidence, {rs("x")} AS magnitude
  FROM (SELECT *, greatest(alarm_low - v, v - alarm_high) AS x, alarm_high - alarm_low AS w FROM e JOIN {SPANS} USING (sensor)) WHERE x > 0"""
)
def detect_range(spark, sf_dir):
    e = events(spark, sf_dir)
    e = spans.attach(e, spans_of(e), "sensor").withColumn("f", detect.out_of_range(F.col("v"))).where("f IS NOT NULL")
    return e.select("event_id", *_fault_columns(F.col("f")))


def _kalman(readings: str) -> str:
    """The filter as a recursion over readings that all have a value."""
    return f"""
o AS (SELECT *, row_number() OVER ({W}) AS rn FROM {readings}),
f AS (
  SELECT sensor, rn, event_id, s, v AS x, 0.0::DOUBLE AS vel, 1000.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1000.0::DOUBLE AS c,
    0.0::DOUBLE AS residual, sqrt(1001.0::DOUBLE) AS sigma, FALSE AS anomaly, FALSE AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT sensor, rn, event_id, s, CASE WHEN far > 10 THEN v ELSE px + pa / vr * res END, CASE WHEN far > 10 THEN 0.0 ELSE pv + pb / vr * res END,
    CASE WHEN far > 10 THEN 1000.0 ELSE (1 - pa / vr) * pa END,
    CASE WHEN far > 10 THEN 0.0 ELSE ((1 - pa / vr) * pb + pb - pb / vr * pa) / 2 END,
    CASE WHEN far > 10 THEN 1000.0 ELSE pc - pb / vr * pb END, res, sqrt(vr), far > 3, far <= 10
  FROM (SELECT *, v - px AS res, pa + 1 AS vr, abs((v - px) / sqrt(pa + 1)) AS far FROM (
    SELECT o.sensor, o.rn, o.event_id, o.s, o.v, f.x + (o.s - f.s) * f.vel AS px, f.vel AS pv,
      f.a + 2 * (o.s - f.s) * f.b + (o.s - f.s) * (o.s - f.s) * f.c + 1e-6 * (o.s - f.s) * (o.s - f.s) * (o.s - f.s) / 3 AS pa,
      f.b + (o.s - f.s) * f.c + 1e-6 * (o.s - f.s) * (o.s - f.s) / 2 AS pb, f.c + 1e-6 * (o.s - f.s) AS pc
    FROM f JOIN o ON o.sensor = f.sensor AND o.rn = f.rn + 1))
)"""


@query(
    f"""WITH RECURSIVE {_kalman(EVENTS)} SELECT event_id, 'kalman_anomaly' AS fault_type, CASE WHEN kept THEN 'medium' ELSE 'high' END AS severity,
  (round({_confidence("abs(residual / sigma)", "3.0", 3.0)}, 4) + 0.0) AS confidence FROM f WHERE anomaly"""
)
def detect_kalman(spark, sf_dir):
    e = events(spark, sf_dir).select("sensor", "ts", "event_id", "s", "v")
    got = kalman.run_filter(e, ["sensor"], ["ts", "event_id"], "s", "v").withColumn("f", detect.residual_fault()).where("f IS NOT NULL")
    return got.select("event_id", F.col("f.fault_type"), F.col("f.severity"), (F.round("f.confidence", 4) + F.lit(0.0)).alias("confidence"))


PAIRS = [(1, 2, 0.5), (1, 3, -0.4), (4, 5, 0.9)]


def _coarse(spark, sf_dir):
    """Readings every 180 s in steps of 40, a thirteenth of them missing, with their sensors' spans."""
    e = events(spark, sf_dir)
    v = F.when(F.col("event_id") % 13 != 0, F.floor(F.col("v") / 40.0) * 40.0)
    rows = steps(e).withColumns({"v": v, "s": F.col("step") * 180.0, "quality": F.lit("good")})
    return spans.attach(rows, spans_of(e), "sensor")


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "a bigint, b bigint, expected double")


def _judged(spark, sf_dir):
    """All detectors over the coarse readings."""
    return detect.all_faults(_coarse(spark, sf_dir), S, "v", "s", _pairs(spark), "event_id", stuck_run=3, rate_limit=1e-5)


_PAIR_ROWS = ", ".join(f"({k}, {a}, {b}, {x}::DOUBLE)" for k, (a, b, x) in enumerate(PAIRS))
# A pair's readings stream in the order of their step, then sensor; each sees the last hundred of both sensors.
APART = f"""pr(pair, a, b, expected) AS (VALUES {_PAIR_ROWS}),
pa AS (SELECT pair, expected, step, event_id, v, 0 AS side, row_number() OVER (PARTITION BY pair ORDER BY step) AS n FROM jv JOIN pr ON jv.sensor = pr.a),
pb AS (SELECT pair, expected, step, event_id, v, 1 AS side, row_number() OVER (PARTITION BY pair ORDER BY step) AS n FROM jv JOIN pr ON jv.sensor = pr.b),
pe AS (SELECT *, sum(1 - side) OVER w AS ra, sum(side) OVER w AS rb FROM (FROM pa UNION ALL FROM pb)
  WINDOW w AS (PARTITION BY pair ORDER BY step, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ps AS (SELECT pa.pair, pa.step, pa.v AS x, pb.v AS y, pa.n AS na, pb.n AS nb FROM pa JOIN pb ON pa.pair = pb.pair AND pa.step = pb.step),
pc AS (SELECT pe.pair, pe.event_id, count(*) AS n, corr(x, y) AS r, stddev_pop(x) * stddev_pop(y) AS p, any_value(expected) AS expected FROM pe JOIN ps ON pe.pair = ps.pair
  AND na > ra - 100 AND nb > rb - 100 AND (ps.step < pe.step OR (ps.step = pe.step AND side = 1)) GROUP BY pe.pair, pe.event_id),
ap AS (SELECT pair, event_id, abs(r - expected) AS far FROM pc WHERE n >= 3 AND p > 0 AND abs(r - expected) > 0.3)"""

JUDGED = f"""e AS {EVENTS}, jb AS (SELECT sensor, kind, event_id, ts, step, step * 180.0::DOUBLE AS s, CASE WHEN event_id % 13 <> 0 THEN floor(v / 40.0) * 40.0 END AS v
  FROM (SELECT *, row_number() OVER ({W}) - 1 AS step FROM e)),
jv AS (SELECT * FROM jb WHERE v IS NOT NULL), {{kalman}}, {APART},
jr AS (SELECT *, row_number() OVER (PARTITION BY sensor, g ORDER BY ts, event_id) AS run FROM (
  SELECT *, sum(t) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
  SELECT *, lag(s) OVER ({W}) AS ls, lag(v) OVER ({W}) AS lv, CASE WHEN v = lag(v) OVER ({W}) THEN 0 ELSE 1 END AS t FROM jv))),
jm AS (SELECT jr.*, low, high, alarm_high - alarm_low AS w, greatest(alarm_low - jr.v, jr.v - alarm_high) AS ex,
  CASE WHEN s - ls > 0 AND alarm_high > alarm_low THEN abs(v - lv) / ((alarm_high - alarm_low) * (s - ls)) END AS rate FROM jr LEFT JOIN {SPANS} USING (sensor)),
jk AS (SELECT jm.*, f.anomaly, f.kept, CASE WHEN f.rn >= 20 AND w > 0 THEN abs(f.vel) * 3600 / w END AS drift FROM jm JOIN f ON jm.event_id = f.event_id),
j AS (SELECT jb.event_id, jb.sensor, jb.kind, CASE WHEN run >= 3 THEN CASE WHEN run / 3.0 >= 4 THEN 3 WHEN run / 3.0 >= 2 THEN 2 ELSE 1 END END AS a,
  CASE WHEN rate > 0.00001 THEN CASE WHEN rate > 5 * 0.00001 THEN 2 ELSE 1 END END AS b,
  CASE WHEN ex > 0 THEN CASE WHEN jk.v < low OR jk.v > high THEN 3 WHEN ex > 0.25 * w THEN 2 ELSE 1 END END AS c,
  CASE WHEN jb.event_id IN (SELECT event_id FROM ap) THEN 1 END AS d, CASE WHEN anomaly THEN CASE WHEN kept THEN 1 ELSE 2 END END AS k,
  CASE WHEN drift > 11 THEN CASE WHEN drift > 55 THEN 2 ELSE 1 END END AS t FROM jb LEFT JOIN jk ON jb.event_id = jk.event_id)"""
JUDGED = JUDGED.replace("{kalman}", _kalman("jv"))
_WORST = "greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0), coalesce(k, 0), coalesce(t, 0))"
_FAULTS = {"stuck": "a", "noise_spike": "b", "bias_out_of_range": "c", "kalman_anomaly": "k", "sensor_drift": "t"}


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT event_id, pair, 'medium' AS severity, {rs(_confidence("far", "0.3", 3.0))} AS confidence, {rs("far")} AS magnitude FROM ap"""
)
def detect_corr(spark, sf_dir):
    """Readings after which a pair of sensors is off its usual correlation."""
    number = F.coalesce(*[F.when((F.col("a") == a) & (F.col("b") == b), F.lit(k)) for k, (a, b, _) in enumerate(PAIRS)])
    pairs = _pairs(spark).withColumn("number", number)
    got = detect.decoupled(_coarse(spark, sf_dir), pairs.coalesce(1).orderBy("number"), (), "sensor", "event_id", "s", "v")
    rank = F.dense_rank().over(Window.orderBy("pair")) - 1
    numbers = got.select("pair").distinct().withColumn("n", rank)
    return got.join(numbers, "pair").select("event_id", F.col("n").alias("pair"), *_fault_columns(F.col("fault"))[1:])


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT event_id, CASE {_WORST} WHEN 3 THEN 'bad' WHEN 0 THEN 'good' ELSE 'suspect' END AS quality FROM j"""
)
def quality_enrich(spark, sf_dir):
    return _judged(spark, sf_dir).select("event_id", "quality")


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT fault_type, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT '{n}' AS fault_type FROM j WHERE {c} IS NOT NULL" for n, c in _FAULTS.items())}
  UNION ALL SELECT 'drift_correlated' FROM ap) GROUP BY fault_type"""
)
def faults_by_type(spark, sf_dir):
    return _judged(spark, sf_dir).select(F.explode("faults.fault_type").alias("fault_type")).groupBy("fault_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT event_id, CASE {_WORST} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' END AS worst FROM j"""
)
def worst_severity(spark, sf_dir):
    names = F.array(*map(F.lit, scalar.SEVERITIES))
    rank = F.array_max(F.transform("faults", lambda f: scalar.severity_rank(f["severity"])))
    return _judged(spark, sf_dir).select("event_id", F.get(names, rank).alias("worst"))


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT kind, {rs(f"1000.0 * count(CASE WHEN {_WORST} > 0 THEN 1 END) / count(*)")} AS per_1000,
  {rs("1000.0 * count(c) / count(*)")} AS range_per_1000 FROM j GROUP BY kind"""
)
def rolling_alert_rate(spark, sf_dir):
    j = _judged(spark, sf_dir)
    ranged = F.exists("faults", lambda f: f["fault_type"] == "bias_out_of_range")
    return j.groupBy("kind").agg(
        r(1000.0 * F.count_if(F.size("faults") > 0) / F.count("*")).alias("per_1000"), r(1000.0 * F.count_if(ranged) / F.count("*")).alias("range_per_1000")
    )


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT count(*) AS readings_total, count(CASE WHEN event_id % 13 = 0 THEN 1 END) AS readings_without_value,
  count(CASE WHEN sensor NOT IN (SELECT sensor FROM {SPANS}) THEN 1 END) AS readings_unknown_sensor,
  cast(sum({" + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _FAULTS.values())}) + (SELECT count(*) FROM ap) AS BIGINT) AS faults_total FROM j"""
)
def judge_counters(spark, sf_dir):
    """What the judge has seen: readings, those without value or span, faults."""
    return detect.counters(_judged(spark, sf_dir), "v")


def _uuid_sql(key: str, namespace: str) -> str:
    h = f"sha1(unhex('{namespace}') || encode({key}))"
    return f"""substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' ||
  substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""


_ALERT_KEY = "concat_ws('|', cast(event_id AS VARCHAR), fault_type, detector, CASE WHEN occurrence > 0 THEN cast(occurrence AS VARCHAR) END)"


@query(
    f"""WITH RECURSIVE {JUDGED}, al AS ({" UNION ALL ".join(f"SELECT event_id, '{n}' AS fault_type, '{detect.NAMES[n]}' AS detector, 0 AS occurrence FROM j WHERE {c} IS NOT NULL" for n, c in _FAULTS.items())}
  UNION ALL SELECT event_id, 'drift_correlated', 'CrossCorrelationChecker', row_number() OVER (PARTITION BY event_id ORDER BY pair) - 1 FROM ap)
  SELECT {_uuid_sql(_ALERT_KEY, detect.ALERTS.hex)} AS alert_id, event_id, fault_type, detector, cast(occurrence AS BIGINT) AS occurrence FROM al"""
)
def alert_ids(spark, sf_dir):
    """Alerts with ids that are the same whenever they are made."""
    return detect.alerts(_judged(spark, sf_dir), "event_id").select("alert_id", "event_id", "fault_type", "detector", "occurrence")


def _told(fault: str, numbers: dict[str, str], rows: str) -> str:
    names, values = ", ".join(f"'{n}'" for n in numbers), ", ".join(f"cast({x} AS DOUBLE)" for x in numbers.values())
    return f"SELECT event_id, '{fault}' AS fault_type, unnest([{names}]) AS name, unnest([{values}]) AS value FROM {rows}"


_EVIDENCE = " UNION ALL ".join([
    _told("stuck", {"run_length": "run", "window_size": "3", "tolerance": "0", "value": "v"}, "jm WHERE run >= 3"),
    _told("noise_spike", {"rate_envelope_fractions_per_second": "rate", "limit": "0.00001", "delta": "v - lv", "elapsed_seconds": "s - ls"}, "jm WHERE rate > 0.00001"),
    _told("bias_out_of_range", {"value": "v", "alarm_min": "alarm_low", "alarm_max": "alarm_high", "excess": "ex", "outside_calibrated_span": "v < low OR v > high"},
          f"(SELECT jm.*, alarm_low, alarm_high FROM jm JOIN {SPANS} USING (sensor)) WHERE ex > 0"),
    _told("drift_correlated", {"observed_pearson": "r", "expected_pearson": "expected", "deviation": "abs(r - expected)"}, "pc WHERE n >= 3 AND p > 0 AND abs(r - expected) > 0.3"),
    _told("kalman_anomaly", {"normalized_residual": "residual / sigma", "residual": "residual", "innovation_sigma": "sigma", "k_sigma": "3", "filter_was_initialized": "kept"}, "f WHERE anomaly"),
    _told("sensor_drift", {"drift_envelope_fractions_per_hour": "drift", "limit": "11", "velocity_units_per_second": "vel", "steps_observed": "rn"},
          "(SELECT jk.*, vel, rn FROM jk JOIN f USING (event_id)) WHERE drift > 11"),
])


@query(
    f"""WITH RECURSIVE {JUDGED} SELECT event_id, fault_type, name, CASE WHEN fault_type IN ('kalman_anomaly', 'sensor_drift') THEN round(value, 4) ELSE round(value, 7) END + 0.0 AS value
  FROM ({_EVIDENCE})"""
)
def alert_evidence(spark, sf_dir):
    """The numbers that led to each alert, by name."""
    told = detect.alerts(_judged(spark, sf_dir), "event_id").select("event_id", "fault_type", F.explode("evidence").alias("name", "value"))
    coarse = F.col("fault_type").isin("kalman_anomaly", "sensor_drift")
    value = F.when(coarse, F.round("value", 4)).otherwise(F.round("value", 7)) + F.lit(0.0)
    return told.select("event_id", "fault_type", "name", value.alias("value"))


@query(
    """SELECT event_id, event_type, cast(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS occurrence FROM events"""
)
def alert_occurrence(spark, sf_dir):
    s = Series(("user_id", "event_type"), ("event_id",))
    return read(spark, sf_dir, "events").select("event_id", "event_type", (F.row_number().over(s.w) - 1).cast("bigint").alias("occurrence"))


# --- Labels.

STEPS = f"(SELECT *, cast(row_number() OVER ({W}) - 1 AS BIGINT) AS step FROM {EVENTS})"
EPISODES = f"""(SELECT sensor, cast(min(step) AS BIGINT) AS start, CASE WHEN sensor % 5 = 0 THEN NULL ELSE cast(min(step) + 9 AS BIGINT) END AS last
  FROM {STEPS} WHERE v > 50 GROUP BY sensor)"""


def steps(e: DataFrame) -> DataFrame:
    return e.withColumn("step", (F.row_number().over(S.w) - 1).cast("bigint"))


def _episodes(rows: DataFrame) -> DataFrame:
    first = rows.where("v > 50").groupBy("sensor").agg(F.min("step").alias("start"))
    return first.withColumn("last", F.when(F.col("sensor") % 5 != 0, F.col("start") + 9))


@query(
    f"""SELECT r.event_id, e.start IS NOT NULL AS labelled, cast(e.start AS DOUBLE) AS start FROM {STEPS} r LEFT JOIN (SELECT * FROM {EPISODES} WHERE last IS NOT NULL) e
  ON r.sensor = e.sensor AND r.step BETWEEN e.start AND e.last"""
)
def label_episodes(spark, sf_dir):
    rows = steps(events(spark, sf_dir))
    got = labels.label(rows, _episodes(rows).where("last IS NOT NULL"), ["sensor"])
    return got.select("event_id", F.col("start").isNotNull().alias("labelled"), F.col("start").cast("double").alias("start"))


@query(
    f"""SELECT r.event_id, e.start IS NOT NULL AS labelled FROM {STEPS} r LEFT JOIN {EPISODES} e
  ON r.sensor = e.sensor AND r.step >= e.start AND (e.last IS NULL OR r.step <= e.last)"""
)
def label_process(spark, sf_dir):
    rows = steps(events(spark, sf_dir))
    return labels.label(rows, _episodes(rows), ["sensor"]).select("event_id", F.col("start").isNotNull().alias("labelled"))


@query(f"SELECT sensor, unnest(range(greatest(start - 3, 0), last + 4)) AS step FROM {EPISODES} WHERE last IS NOT NULL")
def guard_band(spark, sf_dir):
    rows = steps(events(spark, sf_dir))
    return labels.guard_steps(_episodes(rows).where("last IS NOT NULL"), 3, ["sensor"])


def _scored(spark, sf_dir):
    rows = steps(events(spark, sf_dir))
    got = labels.label(rows, _episodes(rows), ["sensor"])
    return got.select("kind", "sensor", "step", (F.col("v") > 60).alias("predicted"), F.col("start").isNotNull().alias("actual"))


SCORED = f"""(SELECT r.kind, r.sensor, r.step, r.v > 60 AS p, e.start IS NOT NULL AS a FROM {STEPS} r LEFT JOIN {EPISODES} e
  ON r.sensor = e.sensor AND r.step >= e.start AND (e.last IS NULL OR r.step <= e.last))"""


@query(
    f"""SELECT *, {rs("CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END")} AS f1,
  CASE WHEN fp + tn > 0 THEN {rs("fp / (fp + tn)")} ELSE 0.0 END AS fpr FROM (SELECT *, CASE WHEN tp + fp > 0 THEN {rs("tp / (tp + fp)")} ELSE 1.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN {rs("tp / (tp + fn)")} ELSE 1.0 END AS recall FROM (SELECT kind, count(CASE WHEN p AND a THEN 1 END) AS tp,
  count(CASE WHEN p AND NOT a THEN 1 END) AS fp, count(CASE WHEN NOT p AND a THEN 1 END) AS fn, count(CASE WHEN NOT p AND NOT a THEN 1 END) AS tn
  FROM {SCORED} GROUP BY kind))"""
)
def confusion(spark, sf_dir):
    got = labels.confusion(_scored(spark, sf_dir), ["kind"])
    got = got.withColumns({c: r(F.col(c)) for c in ("precision", "recall", "fpr")})
    p, q = F.col("precision"), F.col("recall")
    return got.withColumn("f1", r(F.coalesce(scalar.ratio(2 * p * q, p + q), F.lit(0.0))))


@query(f"SELECT sensor, step FROM {SCORED} WHERE p INTERSECT SELECT sensor, step FROM {SCORED} WHERE a")
def set_intersect(spark, sf_dir):
    x = _scored(spark, sf_dir)
    return x.where("predicted").select("sensor", "step").intersect(x.where("actual").select("sensor", "step"))


@query(f"SELECT sensor, step FROM {SCORED} WHERE a EXCEPT SELECT sensor, step FROM {SCORED} WHERE p")
def set_except(spark, sf_dir):
    x = _scored(spark, sf_dir)
    return x.where("actual").select("sensor", "step").subtract(x.where("predicted").select("sensor", "step"))


@query(f"SELECT sensor, step FROM {SCORED} WHERE a UNION SELECT sensor, step FROM {SCORED} WHERE p")
def union_labels(spark, sf_dir):
    return _scored(spark, sf_dir).where("actual OR predicted").select("sensor", "step").distinct()


@query(
    f"""SELECT r.event_id, {rs('''CASE kind WHEN 'freeze' THEN first_value(v) OVER (PARTITION BY r.sensor, e.start ORDER BY step)
  WHEN 'offset' THEN v + 25 WHEN 'spike' THEN CASE WHEN step = start THEN v + 100 ELSE v END WHEN 'ramp' THEN v + 5 * (step - start) ELSE v END''')} AS value,
  CASE WHEN kind = 'freeze' AND step > start THEN 'stuck' WHEN kind = 'offset' THEN 'bias_out_of_range' WHEN kind = 'spike' AND step = start
  THEN 'noise_spike' WHEN kind = 'ramp' THEN 'sensor_drift' END AS label FROM (SELECT sensor, event_id, v, step FROM {STEPS}) r LEFT JOIN (
  SELECT *, ['freeze', 'offset', 'spike', 'ramp'][sensor % 4 + 1] AS kind FROM {EPISODES} WHERE last IS NOT NULL) e
  ON r.sensor = e.sensor AND r.step BETWEEN e.start AND e.last"""
)
def inject_faults(spark, sf_dir):
    rows = steps(events(spark, sf_dir)).select("sensor", "event_id", "v", "step")
    kinds = {0: ("freeze", 0.0), 1: ("offset", 25.0), 2: ("spike", 100.0), 3: ("ramp", 5.0)}
    pick = [F.coalesce(*[F.when(F.col("sensor") % 4 == m, F.lit(k[i])) for m, k in kinds.items()]) for i in (0, 1)]
    ep = _episodes(rows).where("last IS NOT NULL").withColumns({"kind": pick[0], "magnitude": pick[1]})
    return inject.inject(rows, ep, "sensor", "step", "v").select("event_id", r(F.col("v")).alias("value"), "label")


# --- Coverage, rules and reports.


@query(
    """SELECT k.event_type, g.bucket, coalesce(s.n_rows, 0) AS n_rows, coalesce(s.n_sensors, 0) AS n_sensors, s.n_rows IS NOT NULL AS covered
  FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN (SELECT unnest(range(0, 12)) AS bucket) g LEFT JOIN (
  SELECT event_type, cast(floor(value / 25.0) AS BIGINT) AS bucket, count(*) AS n_rows, count(DISTINCT user_id) AS n_sensors FROM events
  GROUP BY 1, 2) s ON s.event_type = k.event_type AND s.bucket = g.bucket"""
)
def grid_coverage(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("bucket", F.floor(F.col("value") / 25.0))
    cells = coverage.grid(kind=e.select("event_type").distinct(), bucket=spark.range(12).withColumnRenamed("id", "bucket"))
    got = coverage.covered(cells, e, ["event_type", "bucket"], n_sensors=F.countDistinct("user_id"))
    return got.select("event_type", "bucket", "n_rows", F.coalesce("n_sensors", F.lit(0)).alias("n_sensors"), "covered")


@query(
    """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders FROM lineitem
  GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_linestatus, l_linenumber))"""
)
def coverage_by_partition(spark, sf_dir):
    return coverage.by_scope(read(spark, sf_dir, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"], n_orders=F.countDistinct("l_orderkey"))


@query(
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"""
)
def rollup_scenarios(spark, sf_dir):
    got = read(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus")
    return got.agg(F.count("*").alias("n"), (F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total"))


_MARGINS = {"ordering": ("v - k", "ordering"), "range": ("least(v, 100 - v)", "range"), "power": ("20 - abs(v - 10 * k)", "power")}


def _margins():
    v, k = F.col("v"), F.col("k")
    return {"ordering": v - k, "range": F.least(v, 100 - v), "power": F.when(k > 2, 20 - F.abs(v - 10 * k))}


MARGINS = f"""(SELECT event_id, kind, 'ordering' AS rule, v - k AS margin FROM {EVENTS} UNION ALL SELECT event_id, kind, 'range', least(v, 100 - v) FROM {EVENTS}
  UNION ALL SELECT event_id, kind, 'power', CASE WHEN k > 2 THEN 20 - abs(v - 10 * k) END FROM {EVENTS})"""


@query(f"SELECT event_id, rule, margin < 0 AS violated FROM {MARGINS} WHERE margin IS NOT NULL")
def rule_eval(spark, sf_dir):
    every = F.array(*[F.struct(F.lit(n).alias("rule"), m.alias("m")) for n, m in _margins().items()])
    long = events(spark, sf_dir).select("event_id", F.explode(every).alias("x")).where("x.m IS NOT NULL")
    return long.select("event_id", "x.rule", (F.col("x.m") < 0).alias("violated"))


@query(
    f"""SELECT kind, rule, count(*) AS n_rows, count(margin) AS n_evaluable, count(CASE WHEN margin < 0 THEN 1 END) AS n_violations,
  {rs("CASE WHEN count(margin) > 0 THEN count(CASE WHEN margin < 0 THEN 1 END) / count(margin) END")} AS rate FROM {MARGINS} GROUP BY kind, rule"""
)
def rule_report(spark, sf_dir):
    return rules.report(events(spark, sf_dir), _margins(), ["kind"]).withColumn("rate", r(F.col("rate")))


@query(
    f"""SELECT kind, rule, {rs("min(margin)")} AS least, {rs("avg(margin)")} AS mean, {rs("stddev_pop(margin)")} AS deviation,
  {rs("CASE WHEN stddev_pop(margin) > 0 THEN avg(margin) / stddev_pop(margin) END")} AS sigmas FROM {MARGINS} GROUP BY kind, rule"""
)
def margin_stats(spark, sf_dir):
    got = rules.margin_stats(events(spark, sf_dir), _margins(), ["kind"])
    return got.withColumns({c: r(F.col(c)) for c in ("least", "mean", "deviation", "sigmas")})


@query(
    f"""SELECT kind, rule, n FROM (SELECT kind, rule, count(CASE WHEN margin < 0 THEN 1 END) AS n FROM {MARGINS} GROUP BY kind, rule)
  WHERE n > 0 AND NOT (kind = 'click' AND rule = 'range')"""
)
def unexpected_violations(spark, sf_dir):
    found = rules.report(events(spark, sf_dir), _margins(), ["kind"])
    allowed = spark.createDataFrame([("click", "range")], "kind string, rule string")
    return rules.unexpected(found, allowed, ["kind", "rule"]).select("kind", "rule", F.col("n_violations").alias("n"))


@query(
    """SELECT hour, role, """
    + rs("median(value)")
    + """ AS value FROM (SELECT date_trunc('hour', ts) AS hour, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'cold' END AS role, value FROM events) GROUP BY hour, role"""
)
def role_median(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    roles = e.select("user_id").distinct().withColumn("role", F.when(F.col("user_id") % 3 == 0, "hot").otherwise("cold"))
    return rules.voted(e, roles, ["hour"], "user_id", "value").withColumn("value", r(F.col("value")))


@query(
    """SELECT kind, weight, cast(f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, kind) <= 100 - total THEN 1 ELSE 0 END AS BIGINT) AS quota
  FROM (SELECT *, sum(f) OVER () AS total FROM (SELECT *, floor(x) AS f FROM (SELECT event_type AS kind, count(*) AS weight,
  100 * count(*) / sum(count(*)) OVER () AS x FROM events GROUP BY event_type)))"""
)
def apportion(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("weight"))
    return splits.apportion(w, 100, ["kind"])


# --- Store and archive.


@query(
    """SELECT q.event_id, CASE WHEN epoch_us(q.ts) - epoch_us(f.ts) <= 86400000000 THEN f.value END AS last_value,
  CASE WHEN epoch_us(q.ts) - epoch_us(f.ts) <= 86400000000 THEN cast(f.event_id AS DOUBLE) END AS last_event FROM (SELECT * FROM events WHERE event_type = 'purchase') q
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') f ON q.user_id = f.user_id AND q.ts >= f.ts"""
)
def asof_ttl(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    asked = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"), F.col("event_id").cast("double").alias("last_event"))
    return store.as_of(asked, seen, ["user_id"], "ts", ["last_value", "last_event"], 86400).select("event_id", "last_value", "last_event")


@query(
    """SELECT k.user_id, cast(l.event_id AS DOUBLE) AS event_id, l.value, CASE WHEN l.ts IS NULL THEN 'missing' WHEN (SELECT max(epoch_us(ts)) FROM events) - epoch_us(l.ts) > 86400000000
  THEN 'stale' ELSE 'fresh' END AS verdict FROM (SELECT c_custkey AS user_id FROM customer) k LEFT JOIN (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) l ON k.user_id = l.user_id"""
)
def latest_freshness(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    last = store.latest(e.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id")
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return store.served(asked, last, ["user_id"], "ts", F.col("now"), 86400).select("user_id", F.col("event_id").cast("double").alias("event_id"), "value", "verdict")


@query(
    """SELECT event_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
  substr(sha1(concat_ws('|', cast(event_id AS VARCHAR), cast(user_id AS VARCHAR), event_type)), 1, 12) AS part FROM events"""
)
def hour_layout(spark, sf_dir):
    e = archive.hourly(read(spark, sf_dir, "events"), "ts", "event_type")
    part = scalar.part_id(F.col("event_id"), F.col("user_id"), F.col("event_type"))
    return e.select("event_id", "year", "month", "day", "hour", part.alias("part"))


RANGE = "ts >= TIMESTAMP '2024-01-05 06:30:00' AND ts < TIMESTAMP '2024-02-20 03:00:00'"


@query(
    f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
  WHERE event_type = 'click' AND {RANGE}) WHERE n = 1"""
)
def range_read_dedup(spark, sf_dir):
    e = archive.hourly(read(spark, sf_dir, "events"), "ts", "event_type").withColumn("at", F.struct("ts", "event_id"))
    near = archive.read_range(e, "click", "2024-01-05 06:30:00", "2024-02-20 03:00:00", "ts", "event_id")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return near.withColumn("n", first).where("n = 1").select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def idempotent_append(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    batch = e.where("event_id % 2 = 0")
    return archive.new_rows(batch.unionByName(batch), e.where("event_id % 3 = 0"), "event_id")


# --- Identity.

_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@query(
    f"""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (
  SELECT event_id, sha1(unhex('{_NAMESPACE}') || encode('plant|' || cast(event_id AS VARCHAR))) AS h FROM events)"""
)
def uuid5_ids(spark, sf_dir):
    key = F.concat(F.lit("plant|"), F.col("event_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", scalar.uuid5(key).alias("id"))


# --- Event-time windows.


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    f"SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, {rs('sum(value)')} AS total FROM events GROUP BY 1, 2"
)
def tumbling_hour(spark, sf_dir):
    e = stream.with_watermark(read(spark, sf_dir, "events"), "ts", "10 minutes")
    got = stream.windowed(e, "ts", "1 hour", None, ["event_type"], n=F.count("*"), total=F.sum("value"))
    return _ntz(got.withColumn("total", r(F.col("total"))), "window_start")


@query(
    """SELECT date_trunc('hour', ts) - to_minutes(30 * cast(o AS INTEGER)) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS window_start,
  event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2"""
)
def sliding_hour(spark, sf_dir):
    e = stream.with_watermark(read(spark, sf_dir, "events"), "ts", "10 minutes")
    return _ntz(stream.windowed(e, "ts", "1 hour", "30 minutes", ["event_type"], n=F.count("*")), "window_start")


@query(
    f"""SELECT sensor AS user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM (SELECT *,
  sum(b) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) <= 7200000000
  THEN 0 ELSE 1 END AS b FROM {EVENTS})) GROUP BY sensor, g"""
)
def session_2h(spark, sf_dir):
    e = stream.with_watermark(read(spark, sf_dir, "events"), "ts", "10 minutes")
    return _ntz(stream.sessions(e, "ts", "2 hours", ["user_id"], n=F.count("*")), "session_start", "session_end")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def top_3_values(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return read(spark, sf_dir, "events").withColumn("n", n).where("n <= 3").select("user_id", "event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_25(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


# --- Studies.

CLOSED = f"(SELECT * FROM {EPISODES} WHERE last IS NOT NULL)"


@query(
    f"""SELECT sensor, start, last, count(*) AS n_window, count(m) AS n_evaluable, count(CASE WHEN m < 0 THEN 1 END) AS n_violations,
  cast(min(CASE WHEN m < 0 THEN step END) - start AS DOUBLE) AS first_delay FROM (SELECT e.*, r.step, CASE WHEN r.k > 20 THEN r.k - r.v END AS m
  FROM {STEPS} r JOIN {CLOSED} e ON r.sensor = e.sensor AND r.step BETWEEN e.start AND e.last) GROUP BY sensor, start, last"""
)
def window_cells(spark, sf_dir):
    rows = steps(events(spark, sf_dir)).withColumn("m", F.when(F.col("k") > 20, F.col("k") - F.col("v")))
    got = studies.window_cells(rows, _episodes(rows).where("last IS NOT NULL"), ["sensor"], "m")
    return got.withColumn("first_delay", F.col("first_delay").cast("double"))


@query(
    f"""WITH m AS (SELECT r.sensor, r.step, r.v > 60 AS f, e.start FROM {STEPS} r LEFT JOIN {CLOSED} e ON r.sensor = e.sensor
  AND r.step BETWEEN e.start AND e.last), h AS (SELECT sensor, start, min(step - start) AS delay FROM m WHERE start IS NOT NULL AND f GROUP BY sensor, start)
  SELECT a.g, n_episodes, n_detected, mean_delay, false_per_1000 FROM (SELECT sensor % 3 AS g, count(*) AS n_episodes, count(delay) AS n_detected,
  {rs("avg(delay)")} AS mean_delay FROM {CLOSED} LEFT JOIN h USING (sensor, start) GROUP BY 1) a LEFT JOIN (SELECT sensor % 3 AS g,
  {rs("1000.0 * count(CASE WHEN f THEN 1 END) / count(*)")} AS false_per_1000 FROM m WHERE start IS NULL GROUP BY 1) b ON a.g = b.g"""
)
def detection_stats(spark, sf_dir):
    rows = steps(events(spark, sf_dir)).withColumns({"f": F.col("v") > 60, "g": F.col("sensor") % 3})
    ep = _episodes(rows).where("last IS NOT NULL").withColumn("g", F.col("sensor") % 3)
    got = studies.detections(rows, ep, ["sensor", "g"], "f", ["g"])
    return got.withColumns({c: r(F.col(c)) for c in ("mean_delay", "false_per_1000")})


@query(
    f"""SELECT sensor, count(*) AS n_rows, count(CASE WHEN kind = 'error' THEN 1 END) AS n_bad, count(CASE WHEN v > 100 THEN 1 END) AS n_high,
  count(CASE WHEN k > 50 THEN 1 END) AS n_labelled FROM {EVENTS} GROUP BY sensor"""
)
def run_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    return studies.run_summary(e, ["sensor"], n_bad=F.col("kind") == "error", n_high=F.col("v") > 100, n_labelled=F.col("k") > 50)


_BANDS = {"v": (150.0, 300.0), "k": (90.0, 99.0)}


@query(
    "\nUNION ALL ".join(
        f"SELECT sensor, '{c}' AS magnitude, cast(min({c}) AS DOUBLE) AS low, cast(max({c}) AS DOUBLE) AS high, max({c}) BETWEEN {a} AND {b} AS on_target FROM {EVENTS} GROUP BY sensor"
        for c, (a, b) in _BANDS.items()
    )
)
def response_extremes(spark, sf_dir):
    return studies.extremes(events(spark, sf_dir), ["sensor"], _BANDS)


@query(
    f"""SELECT kind, min(n) AS least, max(n) AS most, count(*) AS n_runs FROM (SELECT kind, sensor, count(CASE WHEN v > 60 THEN 1 END) AS n
  FROM {EVENTS} GROUP BY kind, sensor) GROUP BY kind"""
)
def violations_over_runs(spark, sf_dir):
    return studies.spread_over_runs(events(spark, sf_dir), ["kind"], "sensor", F.col("v") > 60)


@query(f"SELECT date_trunc('day', ts) AS window_start, count(*) AS n_rows, {rs('count(*) / 86400')} AS per_second FROM events GROUP BY 1")
def throughput_rates(spark, sf_dir):
    got = studies.throughput(read(spark, sf_dir, "events"), "ts", "1 day", 86400)
    return _ntz(got.withColumn("per_second", r(F.col("per_second"))), "window_start")


@query(
    f"""SELECT l_returnflag, {rs("max(abs(x))")} AS worst, count(CASE WHEN abs(x) > 100.0 THEN 1 END) AS n_failures FROM (
  SELECT l_returnflag, l_extendedprice * (l_discount - l_tax) - 10 * l_quantity AS x FROM lineitem) GROUP BY l_returnflag"""
)
def conservation(spark, sf_dir):
    x = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) - 10 * F.col("l_quantity")
    got = studies.conservation(read(spark, sf_dir, "lineitem"), ["l_returnflag"], x, 100.0)
    return got.withColumn("worst", r(F.col("worst")))


# Two runs, and an eleventh of the readings missing; a series is a sensor's run.
FEATURE_ROWS = """(SELECT user_id * 2 + CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS sensor, ts, event_id, event_type AS kind,
  CASE WHEN event_id % 11 <> 0 THEN value END AS v, epoch_us(ts) / 1e6 AS s FROM events)"""


def _feature_sql() -> str:
    """The 28 features in SQL: windows, runs, and the filter as a recursion."""
    fs = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    cols = [f"CASE WHEN count(v) {frame(n)} >= 3 THEN {rs(f'{f}(v) {frame(n)}')} END AS {k}_{n}" for n in features.WINDOWS for k, f in fs.items()]
    cols += [f"lag(v, {k}) OVER ({W}) AS lag_{k}" for k in features.LAGS]
    cols += [
        f"{rs(f'(v - lag(v) OVER ({W})) / 180.0')} AS rate_of_change",
        f"CASE WHEN count(v) {frame(10)} >= 3 AND count(v) {frame(10)} = count(*) {frame(10)} THEN {rs(f'regr_slope(v, rn) {frame(10)} / 180.0')} END AS slope_10",
        f"list(v) {frame(10)} AS l", f"avg(v) {frame(10)} AS m", f"count(v) {frame(10)} AS c", f"count(*) {frame(10)} AS places",
        f"CASE WHEN count(v) {frame(10)} >= 3 THEN stddev_samp(v) {frame(10)} END AS s10",
        f"CASE WHEN count(v) {frame(60)} >= 3 THEN stddev_samp(v) {frame(60)} END AS s60",
        "cast(hour(ts) AS DOUBLE) AS hour_of_day", "cast(isodow(ts) - 1 AS DOUBLE) AS day_of_week",
        f"{rs(chr(39).join(('avg(CASE WHEN kind = ', 'purchase', ' THEN v END) OVER (PARTITION BY sensor % 2, rn)')))} AS power_level_pct",
        f"sum(CASE WHEN v = pv THEN 0 ELSE 1 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g",
    ]
    plain = [c for c in features.feature_names() if c not in ("value", "variance_ratio", "zero_crossing_rate_10", "stuck_run_length") and not c.startswith("kalman")]
    d = "list_filter(list_transform(l, lambda x: sign(x - m)), lambda g: g <> 0)"
    return f"""WITH RECURSIVE {_kalman(f"(SELECT * FROM {FEATURE_ROWS} WHERE v IS NOT NULL)")},
w AS (SELECT sensor, event_id, ts, v AS value, {", ".join(cols)} FROM (SELECT *, lag(v) OVER ({W}) AS pv, cast(row_number() OVER ({W}) AS DOUBLE) AS rn FROM {FEATURE_ROWS})),
z AS (SELECT *, CASE WHEN c < 3 THEN NULL WHEN c < places THEN 1.0 WHEN len(d) < 2 THEN 0.0
  ELSE {rs("len(list_filter(range(1, len(d)), lambda i: d[i] <> d[i + 1])) / (len(d) - 1)")} END AS zero_crossing_rate_10,
  row_number() OVER (PARTITION BY sensor, g ORDER BY ts, event_id) AS stuck_run_length FROM (SELECT *, {d} AS d FROM w))
SELECT z.event_id, value, {", ".join(plain)}, {rs("CASE WHEN s60 > 0 THEN s10 / s60 END")} AS variance_ratio, zero_crossing_rate_10,
  cast(stuck_run_length AS DOUBLE) AS stuck_run_length, (round(residual / sigma, 4) + 0.0) AS kalman_residual, (round(sigma, 4) + 0.0) AS kalman_uncertainty
FROM z LEFT JOIN f ON z.event_id = f.event_id"""


@query(_feature_sql())
def feature_table(spark, sf_dir):
    """All 28 features of every reading."""
    run = F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), 0).otherwise(1)
    rows = events(spark, sf_dir).withColumns({
        "run_id": run, "kind": F.when(F.col("kind") == "purchase", "position").otherwise(F.col("kind")),
        "v": F.when(F.col("event_id") % 11 != 0, F.col("v")),
    })
    rows = rows.withColumn("step", F.row_number().over(Series(("run_id", "sensor"), ("ts", "event_id")).w) - 1)
    got = features.feature_table(rows, "run_id", "sensor", "step", "ts", "v", "kind", 180.0, keep=("event_id",))
    four = ("kalman_residual", "kalman_uncertainty")
    as_is = ("value", "stuck_run_length", "hour_of_day", "day_of_week")
    cols = [
        (F.round(c, 4) + F.lit(0.0) if c in four else F.col(c).cast("double") if c in as_is or c.startswith("lag_") else r(F.col(c))).alias(c)
        for c in features.feature_names()
    ]
    return got.select("event_id", *cols)


# --- The physical rules, messages and checks across tables.

_PLANT = rules.Plant(100.0, 2, 200.0, 1.0, [[4000.0, 4100.0], [5000.0, 5300.0]], [300.0, 330.0], 250.0, 100.0, 110.0, 80.0)


def _instants(spark, sf_dir):
    """Magnitudes of an instant, made from a reading's two channels."""
    v, k = F.col("v"), F.col("k")
    made = {
        "t_out": 280 + v / 5, "t_in": 280 + k / 5, "flow": v - 10, "flow_hot": 50 + v / 50, "flow_cold": 50 + k / 50,
        "p": 100 + k, "flux": k, "p_th": v,
    }
    return events(spark, sf_dir).withColumns(made)


INSTANTS = f"""(SELECT *, 280 + v / 5 AS t_out, 280 + k / 5 AS t_in, v - 10 AS flow, 50 + v / 50 AS flow_hot, 50 + k / 50 AS flow_cold, 100 + k AS p, k AS flux, v AS p_th
  FROM {EVENTS})"""
RULE_MARGINS = f"""(SELECT sensor, kind, event_id,
  CASE WHEN flux > 0 THEN 0.05 - abs(100.0 * flux / 100 - taken) / (100.0 * flux / 100) END AS energy_balance, t_out - t_in AS temperature_ordering,
  10.0 - abs(CASE WHEN dt > 0 THEN (t_out - t_out_before) / dt END) AS heating_rate, least(flow, 100.0 - flow) AS flow_range, 4.5 - abs(p_th - flux) AS power_flux,
  sat - t_out AS boiling, CASE WHEN abs(CASE WHEN dt > 0 THEN (t_avg - t_avg_before) / dt END) < 0.02 AND flow_hot + flow_cold > 0
  THEN 0.055 - abs(flow_hot - flow_cold) / ((flow_hot + flow_cold) / 2) END AS mass_balance
  FROM (SELECT *, 2 * flow * cp * (t_out - t_in) * 1e-6 AS taken FROM (SELECT *,
  CASE WHEN u BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 THEN 4000 * (1 - u) * (1 - w) + 5000 * u * (1 - w) + 4100 * (1 - u) * w + 5300 * u * w END AS cp,
  CASE WHEN w BETWEEN 0 AND 1 THEN 300 * (1 - w) + 330 * w END AS sat FROM (SELECT *, (t_avg - 250) / 100 AS u, (p - 110) / 80 AS w,
  s - lag(s) OVER ({W}) AS dt, lag(t_out) OVER ({W}) AS t_out_before, lag(t_avg) OVER ({W}) AS t_avg_before
  FROM (SELECT *, (t_out + t_in) / 2 AS t_avg FROM {INSTANTS})))))"""


@query(f"SELECT event_id, {', '.join(f'{rs(n)} AS {n}' for n in rules.RULES)} FROM {RULE_MARGINS}")
def physical_margins(spark, sf_dir):
    """The signed distance of every instant to each of the seven rules' limits."""
    got = rules.margins(_instants(spark, sf_dir), _PLANT, S, "s")
    return got.select("event_id", *[r(F.col(n)).alias(n) for n in rules.RULES])


@query(
    "\nUNION ALL ".join(
        f"SELECT kind, '{n}' AS rule, count(*) AS n_rows, count({n}) AS n_evaluable, count(CASE WHEN {n} < 0 THEN 1 END) AS n_violations FROM {RULE_MARGINS} GROUP BY kind"
        for n in rules.RULES
    )
)
def physical_report(spark, sf_dir):
    """Evaluable and broken rules of each class."""
    got = rules.margins(_instants(spark, sf_dir), _PLANT, S, "s")
    return rules.report(got, {n: F.col(n) for n in rules.RULES}, ["kind"]).drop("rate")


_ROLE = "CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'cold' END"


@query(
    f"""SELECT hour, role, {rs("median(value)")} AS value FROM (SELECT date_trunc('hour', ts) AS hour, {_ROLE} AS role, value FROM events
  WHERE user_id % 3 <> 0 OR user_id = 3) GROUP BY hour, role"""
)
def role_single_channel(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumnRenamed("user_id", "channel")
    roles = e.select("channel").distinct().withColumn("role", F.when(F.col("channel") % 3 == 0, "hot").otherwise("cold"))
    got = rules.voted(e, rules.single(roles, 3), ["hour"], "channel", "value")
    return got.withColumn("value", r(F.col("value")))


@query(
    f"""SELECT sensor, step, {rs("CASE WHEN step < 10 THEN 0.0 ELSE greatest(0.0, least(1.0, (step - 10) / (1.0 + sensor % 5), (2 * (1.0 + sensor % 5) + 7 - (step - 10)) / (1.0 + sensor % 5))) END")}
  AS level FROM {STEPS}"""
)
def ramp_envelope(spark, sf_dir):
    rise = (1 + F.col("sensor") % 5).cast("double")
    level = scalar.ramp(F.col("step"), F.lit(10), rise, F.lit(7))
    return steps(events(spark, sf_dir)).select("sensor", "step", r(level).alias("level"))


_TYPE_SQL = "['thermocouple', 'pressure', 'flow', 'odd'][user_id % 4 + 1]"


def _messages(spark, sf_dir):
    """Readings as JSON messages: a fourth with an unknown type, some without a value, some tombstones."""
    e, k = read(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("int")
    kinds = F.get(F.array(*map(F.lit, ("thermocouple", "pressure", "flow", "odd"))), (F.col("user_id") % 4).cast("int"))
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    nested = e.select(
        F.col("event_id").cast("string").alias("reading_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("PLANT-01").alias("plant_id"),
        F.struct(F.col("user_id").cast("string").alias("id"), kinds.alias("type"), F.lit("core").alias("location"), (k * 2.0 - 10).alias("elevation_m")).alias("sensor"),
        F.struct(value.alias("value"), F.lit("bar").alias("unit"), F.lit("good").alias("quality"), (k * 600).alias("raw_counts")).alias("measurement"),
        F.struct(F.lit("2024-01-01").cast("date").alias("calibration_date"), F.lit("2024-01-01").cast("date").alias("last_maintenance"), (k / 10).alias("drift_coefficient")).alias("metadata"),
    )
    sent = readings.encode(nested)
    lost = F.get_json_object("value", "$.reading_id").cast("bigint") % 11 == 0
    return sent.select("key", F.when(~lost, F.col("value")).alias("value"))


_K = "cast(json_extract(props, '$.k') AS BIGINT)"


@query(
    f"""SELECT cast(user_id AS VARCHAR) AS sensor_id, epoch_us(ts) AS at_micros, CASE WHEN event_id % 7 <> 0 THEN value END AS value, cast({_K} * 600 AS INTEGER) AS raw_counts,
  {_K} / 10.0 AS drift_coefficient, {_K} * 2.0 - 10 AS elevation_m FROM events WHERE event_id % 11 <> 0 AND user_id % 4 <> 3 AND {_K} * 2 - 10 <= 100"""
)
def message_roundtrip(spark, sf_dir):
    """Valid messages' numbers after encoding and parsing."""
    good, _ = readings.parse(_messages(spark, sf_dir))
    return readings.numbers(good)


@query(
    f"""SELECT what, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 11 = 0 THEN ['tombstone'] ELSE list_concat(
  CASE WHEN user_id % 4 = 3 THEN ['sensor_type'] ELSE [] END, CASE WHEN {_K} * 2 - 10 > 100 THEN ['elevation'] ELSE [] END) END) AS what FROM events) GROUP BY what"""
)
def quarantine_reasons(spark, sf_dir):
    """What keeps messages out, and how many."""
    _, bad = readings.parse(_messages(spark, sf_dir))
    return bad.select(F.explode("broken").alias("what")).groupBy("what").agg(F.count("*").alias("n"))


@query(
    """SELECT round(avg(covered), 7) + 0.0 AS covered_share, avg(covered) >= 0.9 AS passed FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM events e
  WHERE e.event_type = k.event_type AND floor(e.value / 25.0) = b) THEN 1.0 ELSE 0.0 END AS covered FROM (SELECT DISTINCT event_type FROM events) k,
  (SELECT unnest(range(0, 12)) AS b))"""
)
def coverage_gate(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("bucket", F.floor(F.col("value") / 25.0))
    cells = coverage.grid(kind=e.select("event_type").distinct(), bucket=spark.range(12).withColumnRenamed("id", "bucket"))
    return coverage.gate(coverage.covered(cells, e, ["event_type", "bucket"]), 0.9).withColumn("covered_share", r(F.col("covered_share")))


@query(f"SELECT DISTINCT sensor, step FROM {STEPS} WHERE v > 60 OR v < 10")
def disjoint_labels(spark, sf_dir):
    x = steps(events(spark, sf_dir))
    return labels.merge_disjoint(x.where("v > 60"), x.where("v < 10"), ["sensor", "step"])


@query(
    """SELECT k AS o_orderkey, CASE WHEN f IS NULL THEN 'missing' WHEN n IS NULL THEN 'extra' ELSE 'differs' END AS what FROM (
  SELECT coalesce(m.k, l.k) AS k, m.n, l.f FROM (SELECT o_orderkey AS k, 1 + o_orderkey % 7 AS n FROM orders WHERE o_orderkey % 10 <> 0) m FULL JOIN (
  SELECT l_orderkey AS k, count(*) AS f FROM lineitem GROUP BY 1) l ON m.k = l.k) WHERE n IS DISTINCT FROM f"""
)
def manifest_check(spark, sf_dir):
    """What a manifest of row counts lists against what is there."""
    listed = read(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").selectExpr("o_orderkey", "1 + o_orderkey % 7 AS n")
    there = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return checks.mismatched(listed, there, ["o_orderkey"], ["n"])


@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9._-]*') AS valid FROM part")
def safe_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").rlike(checks.PLANT_ID).alias("valid"))


# --- Any channel, dense grids, curves, reducers and rates by phase.


@query(
    f"""SELECT hour, {rs("min(10.0 - abs(CASE WHEN dt > 0 THEN (v - before) / dt END))")} AS heating_rate FROM (
  SELECT date_trunc('hour', ts) AS hour, v, lag(v) OVER ({W}) AS before, s - lag(s) OVER ({W}) AS dt FROM {EVENTS}) GROUP BY hour"""
)
def heating_any_channel(spark, sf_dir):
    """Of each hour, how far its fastest channel is from the limit of heating."""
    e = events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rules.heating_margins(e, S, "v", "s", 10.0, ["hour"]).withColumn("heating_rate", r(F.col("heating_rate")))


@query(
    f"""SELECT date_trunc('hour', ts) AS hour, {rs("min(CASE WHEN v IS NOT NULL THEN least(v, 100.0 - v) END)")} AS flow_range FROM {EVENTS} GROUP BY 1"""
)
def flow_any_channel(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rules.flow_margins(e, "v", 200.0, 2, ["hour"]).withColumn("flow_range", r(F.col("flow_range")))


_CELLS = "(SELECT date_trunc('hour', ts) AS hour, user_id % 40 AS channel, max(value) AS value FROM events GROUP BY 1, 2)"


@query(
    f"""SELECT hour, channel, value FROM (SELECT DISTINCT hour FROM {_CELLS}) CROSS JOIN (SELECT unnest(range(0, 40)) AS channel) LEFT JOIN {_CELLS} USING (hour, channel)"""
)
def dense_grid(spark, sf_dir):
    """A cell for every channel of every hour, null where no channel reported."""
    e = read(spark, sf_dir, "events")
    cells = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("user_id") % 40).alias("channel")).agg(F.max("value").alias("value"))
    return coverage.dense(cells, ["hour"], "channel", list(range(40)))


@query(
    f"""SELECT split, cast(sum(c) AS BIGINT) AS n_rows, count(*) AS n_classes, count(*) = (SELECT count(DISTINCT event_type) FROM events) AS all_classes, min(c) >= 100 AS enough
  FROM (SELECT split, event_type, count(*) AS c FROM {SPLIT} GROUP BY split, event_type) GROUP BY split"""
)
def split_gates(spark, sf_dir):
    return splits.gates(_split(spark, sf_dir), ["event_type"], "ts", 100)


_CURVE = ([0.0, 40.0, 75.0, 300.0], [1.0, 2.5, 9.0, 80.0])


@query(
    f"""SELECT event_id, {rs("CASE WHEN value BETWEEN 0 AND 40 THEN 1.0 + value / 40.0 * 1.5 WHEN value BETWEEN 40 AND 75 THEN 2.5 + (value - 40) / 35.0 * 6.5 WHEN value BETWEEN 75 AND 300 THEN 9.0 + (value - 75) / 225.0 * 71.0 END")}
  AS pressure FROM events"""
)
def saturation_pressure(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", r(scalar.curve(*_CURVE, F.col("value"))).alias("pressure"))


@query(
    f"""SELECT event_id, {rs("CASE WHEN value > 0 AND folded >= 1e-12 THEN 1.0 / folded END")} AS seen FROM (
  SELECT event_id, value, abs(7.0 / value - floor(7.0 / value + 0.5)) / 7.0 AS folded FROM events)"""
)
def aliased_periods(spark, sf_dir):
    """The period that a sampled oscillation of a reading's period seems to have."""
    seen = scalar.aliased_period(F.col("value"), 7.0)
    return read(spark, sf_dir, "events").select("event_id", r(seen).alias("seen"))


_GAPPED = f"(SELECT *, CASE WHEN event_id % 13 <> 0 THEN v END AS x FROM {EVENTS})"


@query(
    f"""SELECT event_id, CASE WHEN n >= 3 THEN list_sort(list_filter(l, lambda y: y IS NOT NULL))[5] END AS fifth,
  CASE WHEN n >= 3 THEN cast(coalesce(list_position(list_transform(l, lambda y: y IS NULL), TRUE), 0) AS BIGINT) END AS gap_place,
  CASE WHEN n >= 3 THEN {rs("list_sum(list_transform(l, lambda y, i: i * coalesce(y, 0.0)))")} END AS weighted
  FROM (SELECT event_id, list(x) {frame(10)} AS l, count(x) {frame(10)} AS n FROM {_GAPPED})"""
)
def window_reducer(spark, sf_dir):
    """Any function of a window's places, missing values among them: the fifth from below, the first gap's place, a sum weighted by places."""
    x = F.when(F.col("event_id") % 13 != 0, F.col("v"))
    reduced = {
        "fifth": lambda l: F.get(F.array_sort(F.filter(l, lambda y: y.isNotNull())), F.lit(4)),
        "gap_place": lambda l: F.array_position(F.transform(l, lambda y: y.isNull()), True),
        "weighted": lambda l: r(F.aggregate(F.transform(l, lambda y, i: (i + 1) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda a, y: a + y)),
    }
    return events(spark, sf_dir).select("event_id", *[S.reduced(f, x, 10).alias(name) for name, f in reduced.items()])


@query(
    f"""WITH RECURSIVE {JUDGED}, ap_n AS (SELECT event_id, count(*) AS n_pairs FROM ap GROUP BY event_id), phased AS (
  SELECT j.event_id % 3 = 0 AS hold, kind, {" + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _FAULTS.values())} + coalesce(n_pairs, 0) AS n
  FROM j LEFT JOIN ap_n ON ap_n.event_id = j.event_id)
  SELECT kind, {rs("1000.0 * sum(n) / count(*)")} AS per_1000, {rs("1000.0 * sum(CASE WHEN hold THEN n END) / count(CASE WHEN hold THEN 1 END)")} AS per_1000_hold,
  {rs("1000.0 * sum(CASE WHEN NOT hold THEN n END) / count(CASE WHEN NOT hold THEN 1 END)")} AS per_1000_ramp FROM phased GROUP BY kind"""
)
def alert_rates_by_phase(spark, sf_dir):
    hold = F.col("event_id") % 3 == 0
    got = detect.alert_rates(_judged(spark, sf_dir), ["kind"], {"hold": hold, "ramp": ~hold})
    return got.select("kind", *[r(F.col(c)).alias(c) for c in got.columns if c != "kind"])


# --- Placement of injected faults.

PLAN = placement.Plan(3, 2, {"freeze": (9, 14), "offset": (4, 10), "spike": (1, 1), "ramp": (8, 12)}, guard=3)
SEED = 20260721
_PLACE_ROWS = f"""(SELECT cast(sensor % 12 AS BIGINT) AS sensor, v, cast(row_number() OVER (PARTITION BY sensor % 12 ORDER BY ts, event_id) - 1 AS BIGINT) AS step FROM {EVENTS})"""


def _draw_sql(seed: int, *keys: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'cast({k} AS VARCHAR)' for k in keys)})), 1, 15) AS BIGINT)"


def _between_sql(number: str, low: float, high: float) -> str:
    return f"({low}::DOUBLE + {high - low}::DOUBLE * (({number} >> 8) / {1 << 52}::DOUBLE))"


_LENGTH = " ".join(f"WHEN '{k}' THEN {low} + d1 % {high - low + 1}" for k, (low, high) in PLAN.lengths.items())
_KIND_OF = "CASE place // 3 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(PLAN.lengths)) + " END"
PLACED = f"""rd AS {_PLACE_ROWS}, tl AS (SELECT sensor, count(*) AS n_steps FROM rd GROUP BY sensor),
tg AS (SELECT sensor, n_steps, {_KIND_OF} AS kind FROM (SELECT *, row_number() OVER (ORDER BY {_draw_sql(SEED, "sensor")}, sensor) - 1 AS place FROM tl) WHERE place < 12),
ee AS (SELECT *, {_draw_sql(SEED + 1, "sensor", "episode")} AS d1, {_draw_sql(SEED + 2, "sensor", "episode")} AS d2, {_draw_sql(SEED + 3, "sensor", "episode")} AS d3,
  {_draw_sql(SEED + 4, "sensor", "episode")} AS d4, n_steps // 2 AS seg FROM tg, (SELECT unnest([0, 1]) AS episode)),
el AS (SELECT *, CASE kind {_LENGTH} END AS len FROM ee),
es AS (SELECT *, episode * seg + 3 + d2 % ((episode + 1) * seg - 3 - len - (episode * seg + 3) + 1) AS start FROM el),
ep AS (SELECT sensor, kind, episode, n_steps - 1 AS last_step, cast(start AS BIGINT) AS start, cast(start + len - 1 AS BIGINT) AS last,
  CASE WHEN d3 % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS up, d4 FROM es)"""


def _placed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings of twelve sensors, their number of steps, and the episodes."""
    rows = events(spark, sf_dir).withColumn("sensor", F.col("sensor") % 12)
    rows = rows.withColumn("step", (F.row_number().over(S.w) - 1).cast("bigint")).select("sensor", "step", "v")
    timelines = rows.groupBy("sensor").agg(F.count("*").alias("n_steps"))
    return rows, timelines, placement.episodes(timelines, [], "sensor", "n_steps", PLAN, SEED)


@query(f"WITH {PLACED} SELECT sensor, kind, cast(episode AS INTEGER) AS episode, start, last, up AS direction FROM ep")
def place_episodes(spark, sf_dir):
    """Injected faults: disjoint sensors for each kind, an episode in each half of a timeline."""
    return _placed(spark, sf_dir)[2]


@query(
    f"""WITH {PLACED}, sp AS (SELECT sensor, avg(v) - stddev_samp(v) AS lo, avg(v) + stddev_samp(v) AS hi FROM rd GROUP BY sensor),
  wr AS (SELECT ep.sensor, ep.start, min(v) AS a, max(v) AS b FROM ep JOIN rd ON rd.sensor = ep.sensor AND step BETWEEN start AND last GROUP BY ep.sensor, ep.start)
  SELECT sensor, cast(episode AS INTEGER) AS episode, {rs("m")} AS magnitude, {rs("CASE kind WHEN 'ramp' THEN m * 3600.0 / 180.0 / w ELSE m / w END")} AS widths FROM (
  SELECT ep.sensor, episode, kind, hi - lo AS w, CASE kind WHEN 'offset' THEN CASE WHEN up > 0 THEN hi - a + 0.35 * (hi - lo) ELSE lo - b - 0.35 * (hi - lo) END
    WHEN 'spike' THEN up * {_between_sql("d4", 1.5, 4.0)} * (hi - lo) WHEN 'ramp' THEN up * {_between_sql("d4", 13.0, 17.0)} * (hi - lo) * 180.0 / 3600.0 ELSE 0.0 END AS m
  FROM ep JOIN sp ON sp.sensor = ep.sensor JOIN wr ON wr.sensor = ep.sensor AND wr.start = ep.start)"""
)
def size_episodes(spark, sf_dir):
    """How large the placed faults are, from the envelopes and, for an offset, from the worst value of its window."""
    rows, _, placed = _placed(spark, sf_dir)
    mean, sd = F.avg("v"), F.stddev_samp("v")
    envelopes = rows.groupBy("sensor").agg((mean - sd).alias("alarm_low"), (mean + sd).alias("alarm_high"))
    got = placement.sized(placed, rows, envelopes, [], "sensor", "step", "v", 180.0, PLAN, SEED)
    return got.select("sensor", "episode", r(F.col("magnitude")).alias("magnitude"), r(F.col("widths")).alias("widths"))


@query(
    f"""WITH {PLACED} SELECT fault_type, count(*) AS n, count(DISTINCT sensor) AS n_sensors, cast(sum(step) AS BIGINT) AS steps FROM (SELECT DISTINCT sensor, fault_type, step FROM (
  SELECT sensor, last_step, 'kalman_anomaly' AS fault_type, unnest(range(start, last + 2)) AS step FROM ep UNION ALL
  SELECT sensor, last_step, 'stuck', unnest(range(start + 1, last + 1)) FROM ep WHERE kind = 'freeze' UNION ALL
  SELECT sensor, last_step, 'sensor_drift', unnest(range(start, last + 1)) FROM ep WHERE kind = 'ramp' UNION ALL
  SELECT sensor, last_step, 'noise_spike', unnest(CASE WHEN kind IN ('offset', 'spike') THEN [start, last + 1] ELSE [last + 1] END) FROM ep) WHERE step <= last_step) GROUP BY fault_type"""
)
def injected_truth(spark, sf_dir):
    """Where the placed faults must be found."""
    _, timelines, placed = _placed(spark, sf_dir)
    lines = timelines.select("sensor", (F.col("n_steps") - 1).alias("last_step"))
    found = placement.truth(placed.join(lines, "sensor"), ["sensor"], "last_step")
    return found.groupBy("fault_type").agg(F.count("*").alias("n"), F.countDistinct("sensor").alias("n_sensors"), F.sum("step").alias("steps"))


# --- Tables that are written.


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share; of this machine only where the session names none and runs here alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{named or 'file://' + tempfile.gettempdir()}/{uuid.uuid4().hex}"


def _dropped(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@query(
    """SELECT 'P' AS plant, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
  CASE WHEN count(CASE WHEN NOT (day(ts) <= 20 AND event_id % 5 <> 0) THEN 1 END) > 0 THEN 'created' ELSE 'existing' END AS answer,
  count(CASE WHEN NOT (day(ts) <= 20 AND event_id % 5 <> 0) THEN 1 END) AS added FROM events GROUP BY ALL"""
)
def append_answers(spark, sf_dir):
    """What an archive says of a batch that it holds in part: which hours it created and which were there."""
    e = read(spark, sf_dir, "events").withColumns({"plant_id": F.lit("P"), "ts": F.col("ts").cast("timestamp")}).select("event_id", "ts", "plant_id", "value")
    folder = _folder(spark)
    try:
        archive.append(spark, e.where("dayofmonth(ts) <= 20 AND event_id % 5 <> 0"), folder, "ts", "event_id")
        return archive.append(spark, e, folder, "ts", "event_id")
    finally:
        _dropped(spark, folder)


# --- Sketches.

ERROR = 0.02
_BUCKET = f"CASE WHEN x > 0 THEN cast(ceil(ln(x) / ln({sketches.gamma(ERROR)!r}::DOUBLE)) AS BIGINT) ELSE {sketches.NONE} END"


@query(
    f"""WITH late AS (SELECT event_type AS kind, value AS x FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 500),
  c AS (SELECT kind, b, n, sum(n) OVER (PARTITION BY kind) AS total, sum(n) OVER (PARTITION BY kind ORDER BY b) AS so_far FROM (
    SELECT kind, {_BUCKET} AS b, count(*) AS n FROM late WHERE x IS NOT NULL GROUP BY ALL))
  SELECT kind, cast(max(total) AS BIGINT) AS n, {", ".join(
    f"{rs(f'2 * pow({sketches.gamma(ERROR)!r}::DOUBLE, min(CASE WHEN so_far >= greatest(1, ceil({q} * total)) THEN b END)) / {sketches.gamma(ERROR) + 1!r}::DOUBLE')} AS {name}"
    for name, q in (("p50", 0.5), ("p99", 0.99)))} FROM c GROUP BY kind"""
)
def latency_percentiles(spark, sf_dir):
    """Median and 99th percentile of each kind's last 500 readings, within two hundredths, from counts that add up."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts", "event_id", F.col("value").alias("x"))
    last = e.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 500")
    got = sketches.quantiles(sketches.counts(last, ["kind"], "x", ERROR), ["kind"], {"p50": 0.5, "p99": 0.99}, ERROR)
    return got.select("kind", "n", r(F.col("p50")).alias("p50"), r(F.col("p99")).alias("p99"))


@query(
    """SELECT c.c_custkey AS user_id, CASE WHEN c.c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) THEN cast(l.event_id AS DOUBLE) END AS event_id, l.value FROM customer c
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) l ON l.user_id = c.c_custkey"""
)
def key_lookup(spark, sf_dir):
    """The latest reading of each customer, from a table in buckets that three merges made."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    folder = _folder(spark)
    try:
        for version, part in enumerate(("ts < '2024-01-11'", "ts >= '2024-01-21'", "ts >= '2024-01-11' AND ts < '2024-01-21'")):
            store.materialize(e.where(part), folder, ["user_id"], "ts", "event_id", version, 16)
        asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
        got = store.lookup(asked, folder).select("user_id", F.col("event_id").cast("double").alias("event_id"), "value").toArrow()
        return spark.createDataFrame(got)
    finally:
        _dropped(spark, folder)


# --- Coverage by sets.

_SCOPES = [["l_linestatus", "l_returnflag", "l_linenumber"], ["l_returnflag", "l_linenumber"], ["l_linestatus"], []]


@query(
    f"""SELECT scope, l_linestatus, l_returnflag, l_linenumber, n_rows, corrupted, n_episodes, n_runs FROM ({" UNION ALL ".join(
    f"""SELECT {k} AS scope, {', '.join(a if a in scope else f'NULL AS {a}' for a in _SCOPES[0])}, count(*) AS n_rows, cast(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS corrupted,
  count(DISTINCT l_orderkey) AS n_episodes, count(DISTINCT l_suppkey) AS n_runs FROM lineitem GROUP BY ALL""" for k, scope in enumerate(_SCOPES))})"""
)
def coverage_sets(spark, sf_dir):
    """Rows, corrupted ones, distinct episodes and runs of every cell, type, partition and of all, from one pass: sets that add up."""
    rows = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_linenumber", "l_orderkey", "l_suppkey", "l_discount")
    sets = coverage.id_sets(rows, _SCOPES[0], {"episodes": "l_orderkey", "runs": "l_suppkey"}, {"corrupted": (F.col("l_discount") > 0.05).cast("bigint")})
    return coverage.scoped(sets, _SCOPES[0], _SCOPES, ["episodes", "runs"], ["corrupted"])


# --- Dimensions that name each other.


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS parent FROM nation), s AS (SELECT s_suppkey AS k, s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 100 ELSE 0 END AS nation, s_acctbal AS bal FROM supplier),
  b AS (SELECT n_nationkey AS k, -100.0 * n_nationkey AS lo, 4000.0 + 200.0 * n_nationkey AS hi FROM nation)
  SELECT 'supplier' AS dimension, 'orphan' AS kind, cast(k AS VARCHAR) AS key FROM s WHERE nation NOT IN (SELECT k FROM n)
  UNION ALL SELECT 'supplier', 'out_of_range', cast(s.k AS VARCHAR) FROM s JOIN b ON b.k = s.nation WHERE bal < lo OR bal > hi
  UNION ALL SELECT 'supplier', 'rule', cast(k AS VARCHAR) FROM s WHERE NOT bal > -900
  UNION ALL SELECT 'nation', 'cyclic', cast(k AS VARCHAR) FROM n"""
)
def dimension_defects(spark, sf_dir):
    """What is wrong with suppliers and nations that name each other: every nation here ends in a circle of parents."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("parent"), (-100.0 * F.col("n_nationkey")).alias("lo"), (4000.0 + 200.0 * F.col("n_nationkey")).alias("hi"))
    moved = F.col("s_nationkey") + F.when(F.col("s_suppkey") % 7 == 0, 100).otherwise(0)
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", moved.alias("nation"), "s_acctbal")
    got = checks.defects({
        "nation": checks.Dimension(nation, "n_nationkey", parent="parent"),
        "supplier": checks.Dimension(supplier, "s_suppkey", {"balance": F.col("s_acctbal") > -900}, {"nation": "nation"}, {"s_acctbal": ("nation", "lo", "hi")}),
    })
    return got.select("dimension", "kind", "key")


# --- Labelled data sets.

_FAULTY = {"click": "void_formation", "view": "drift", "purchase": "stuck", "signup": "coolant_flow_reduction"}
_FAULT_OF = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in _FAULTY.items()) + " END"
_SEVERITY_OF = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s) in dataset.SCENARIOS.items() if s) + " END"
_PROCESS = ", ".join(f"'{k}'" for k, (a, _) in dataset.SCENARIOS.items() if a == "process")
# A run is a kind of event, with four sensors; a reading's true value is whole.
_RUNS = f"""(SELECT kind AS run_id, sensor % 4 AS sensor_id, ts, event_id, CASE WHEN {_FAULT_OF} IN ('drift', 'stuck') AND v > 60 THEN v ELSE floor(v) END AS value, floor(v) AS true_value, v,
  coalesce({_FAULT_OF}, 'normal') AS scenario, cast(row_number() OVER (PARTITION BY kind, sensor % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS timestep FROM {EVENTS})"""
LABELLED = f"""rr AS {_RUNS}, fe AS (SELECT run_id, CASE WHEN scenario IN ({_PROCESS}) THEN NULL ELSE sensor_id END AS sensor_id, scenario AS fault, min(timestep) AS start
  FROM rr WHERE scenario <> 'normal' AND v > 40 GROUP BY ALL),
ee AS (SELECT *, CASE WHEN start % 3 = 0 THEN NULL ELSE start + 19 END AS last, concat_ws('/', run_id, cast(sensor_id AS VARCHAR), fault, cast(start AS VARCHAR)) AS id FROM fe),
lb AS (SELECT rr.*, p.fault AS pf, i.fault AS f, coalesce(i.id, p.id) AS episode_id, coalesce(i.start, p.start) AS injected_at_step FROM rr
  LEFT JOIN ee p ON p.sensor_id IS NULL AND p.run_id = rr.run_id AND timestep >= p.start AND (p.last IS NULL OR timestep <= p.last)
  LEFT JOIN ee i ON i.sensor_id = rr.sensor_id AND i.run_id = rr.run_id AND timestep >= i.start AND (i.last IS NULL OR timestep <= i.last))"""


def _labelled(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where("v IS NOT NULL")
    fault = F.create_map(*[F.lit(x) for pair in _FAULTY.items() for x in pair])[F.col("kind")]
    bent = fault.isin("drift", "stuck") & (F.col("v") > 60)
    rows = e.select(
        F.col("kind").alias("run_id"), (F.col("sensor") % 4).alias("sensor_id"), "ts", "event_id", "v", F.coalesce(fault, F.lit("normal")).alias("scenario"),
        F.when(bent, F.col("v")).otherwise(F.floor("v").cast("double")).alias("value"), F.floor("v").cast("double").alias("true_value"),
    )
    rows = rows.withColumn("timestep", (F.row_number().over(Series(("run_id", "sensor_id"), ("ts", "event_id")).w) - 1).cast("bigint"))
    sensor = F.when(dataset.axis_of(F.col("scenario")) == "instrument", F.col("sensor_id"))
    episodes = rows.where("scenario <> 'normal' AND v > 40").groupBy("run_id", sensor.alias("sensor_id"), F.col("scenario").alias("fault")).agg(F.min("timestep").alias("start"))
    episodes = episodes.withColumns({"last": F.when(F.col("start") % 3 != 0, F.col("start") + 19), "level": F.lit("full")})
    return dataset.assemble(rows, episodes, dataset.Columns(at="ts"))


@query(
    f"""WITH {LABELLED} SELECT event_id, coalesce(pf, 'none') AS process_fault, {_SEVERITY_OF.format("pf")} AS process_severity, coalesce(f, 'none') AS instrument_fault,
  {_SEVERITY_OF.format("f")} AS instrument_severity, episode_id, cast(injected_at_step AS DOUBLE) AS injected_at_step, CASE WHEN episode_id IS NOT NULL THEN epoch_us(min(CASE WHEN timestep = injected_at_step THEN ts END)
  OVER (PARTITION BY episode_id, run_id)) END::DOUBLE AS injected_us, f IS NOT NULL AND value <> true_value AS corrupted, pf IS NOT NULL OR f IS NOT NULL AS labelled FROM lb"""
)
def label_axes(spark, sf_dir):
    """Every reading's labels on both axes: the process's, for all sensors of a run, and the instrument's."""
    got = _labelled(spark, sf_dir)
    us = F.unix_micros(F.col("injected_at").cast("timestamp")).cast("double")
    return got.select(
        "event_id", "process_fault", "process_severity", "instrument_fault", "instrument_severity", "episode_id",
        F.col("injected_at_step").cast("double").alias("injected_at_step"), us.alias("injected_us"), "corrupted", "labelled",
    )


@query(
    f"""WITH {LABELLED} SELECT scenario, count(DISTINCT run_id) AS runs, count(*) AS readings, count(CASE WHEN pf IS NOT NULL OR f IS NOT NULL THEN 1 END) AS labelled,
  count(CASE WHEN f IS NOT NULL AND value <> true_value THEN 1 END) AS corrupted, count(DISTINCT episode_id) AS episodes FROM lb GROUP BY ROLLUP (scenario)"""
)
def dataset_summary(spark, sf_dir):
    """What a labelled data set holds, by scenario and in all."""
    return dataset.by_scenario(_labelled(spark, sf_dir))


@query(
    f"""WITH {LABELLED}, t AS (SELECT coalesce({_SEVERITY_OF.format("f")}, {_SEVERITY_OF.format("pf")}) AS s FROM lb)
  SELECT severity, count(CASE WHEN s = severity THEN 1 END) AS readings, {rs("count(CASE WHEN s = severity THEN 1 END) / count(*)")} AS fraction
  FROM t, (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity) GROUP BY severity"""
)
def severity_fractions(spark, sf_dir):
    """The share of all readings that each severity labels."""
    return dataset.by_severity(_labelled(spark, sf_dir)).select("severity", "readings", r(F.col("fraction")).alias("fraction"))


_RULES = {"above_80": "value > 80", "below_5": "value < 5", "uncertain": "value <> true_value"}


@query(
    f"""WITH {LABELLED} SELECT scenario, {", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in _RULES.items())} FROM lb GROUP BY scenario
  HAVING count(CASE WHEN {" OR ".join(_RULES.values())} THEN 1 END) > 0"""
)
def scenario_rule_matrix(spark, sf_dir):
    """How often each scenario breaks each rule."""
    rows = _labelled(spark, sf_dir)
    broken = checks.violations(rows, {n: ~F.expr(c) for n, c in _RULES.items()}, ["scenario"])
    return dataset.rule_matrix(broken, "scenario", "rule", list(_RULES))


@query(
    """SELECT o_orderkey, CASE WHEN o.us - f.us <= 172800000000 THEN f.value END AS value FROM (SELECT o_orderkey, cast(o_custkey % 15 AS VARCHAR) AS e,
    epoch_us(TIMESTAMP '2024-01-01' + to_seconds(cast(o_orderkey % 2592000 AS BIGINT))) AS us FROM orders) o
  ASOF LEFT JOIN (SELECT e, us, value FROM (SELECT *, row_number() OVER (PARTITION BY e, us ORDER BY event_id DESC) AS n FROM (
    SELECT cast(user_id % 15 AS VARCHAR) AS e, epoch_us(date_trunc('hour', ts)) AS us, event_id, value FROM events)) WHERE n = 1) f ON o.e = f.e AND o.us >= f.us"""
)
def feature_view_history(spark, sf_dir):
    """The feature that held for each order's entity and time, through a view with its time to live; of an hour's rows the last made counts."""
    view = views.FeatureView("readings", 172800, features=("value",))
    made = F.timestamp_seconds(F.col("event_id"))
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 15).cast("string").alias("sensor_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("event_timestamp"), made.alias("created_timestamp"), "value")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("o_orderkey") % 2592000)
    asked = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 15).cast("string").alias("sensor_id"), at.alias("event_timestamp"))
    return view.history(asked, rows).select("o_orderkey", "value")

"""Operators on small frames: edges that the driver's tables don't have."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxgauge.functions import scalar
from fluxgauge.functions.windows import Series
from fluxgauge.operators import checks, coverage, dataset, detect, features, inject, kalman, labels, placement, rules, spans, splits, store, tracks, views

S = Series(("sensor",), ("step",))


def series(spark, values, sensor="a"):
    return spark.createDataFrame([(sensor, i, v) for i, v in enumerate(values)], "sensor string, step bigint, v double")


def column(df, name, order="step"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_windows_need_values(spark):
    df = series(spark, [1.0, None, float("nan"), 3.0, 5.0]).withColumn("v", scalar.clean(F.col("v")))
    assert column(df.select("step", S.mean(F.col("v"), 4).alias("m")), "m") == [None, None, None, None, None]
    assert column(df.select("step", S.mean(F.col("v"), 5).alias("m")), "m") == [None, None, None, None, 3.0]


def test_slope_and_short_windows(spark):
    df = series(spark, [0.0, 2.0, 4.0, 6.0])
    assert column(df.select("step", S.slope(F.col("v"), 3, 2.0).alias("m")), "m") == [0.0, 1.0, 1.0, 1.0]


def test_constant_series_has_no_correlation_and_no_crossings(spark):
    df = series(spark, [5.0] * 6)
    got = df.select("step", S.pair_correlation(F.col("v"), F.col("v"), 4).alias("c"), S.zero_crossings(F.col("v"), 4).alias("z"))
    assert column(got, "c") == [None] * 6
    assert column(got, "z") == [0.0] * 6


def test_crossings_skip_values_on_the_mean(spark):
    df = series(spark, [1.0, 3.0, 2.0, 1.0, 3.0])
    assert column(df.select("step", S.zero_crossings(F.col("v"), 5).alias("z")), "z")[-1] == 1.0


def test_runs_break_at_nulls(spark):
    df = detect.run_length(series(spark, [1.0, 1.0, None, 1.0, 1.0, 1.0]), S, "v")
    assert column(df, "run") == [1, 2, 1, 1, 2, 3]


def test_repeats_pass_nulls_by(spark):
    def runs(values, near):
        df = series(spark, values).withColumns({"s": F.col("step").cast("double"), "near": F.lit(near)})
        return column(tracks.tracked(df, ["sensor"], ["step"], "s", "v", "near"), "run")

    assert runs([1.0, 1.0, None, 1.0, 1.25, 1.0, None], 0.0) == [1, 2, None, 3, 1, 1, None]
    assert runs([1.0, 1.0, None, 1.0, 1.25, 1.0], 0.25) == [1, 2, None, 3, 4, 5]


def test_pairs_with_repeated_instants_and_long_series():
    """The last hundred readings of both sides, one instant's later values in place, against a plain loop; chunks don't matter."""
    rng = np.random.default_rng(3)
    n = 3000
    side = rng.integers(0, 2, n)
    at = np.sort(rng.integers(0, 1200, n)).astype(float)
    x = np.round(rng.normal(size=n), 1)
    x[500:900] = 7.0
    whole, parts = detect.Pair(20), detect.Pair(20)
    got = whole.observe(side, at, x)
    cut = np.concatenate([parts.observe(side[a : a + 137], at[a : a + 137], x[a : a + 137]) for a in range(0, n, 137)])
    assert np.array_equal(got, cut, equal_nan=True)
    mine, other = [], []
    for i in range(n):
        (other if side[i] else mine).append((at[i], x[i]))
        last = {t: v for t, v in other[-20:]}
        both = [(v, last[t]) for t, v in mine[-20:] if t in last]
        a, b = zip(*both, strict=True) if both else ((), ())
        want = np.nan if len(both) < 3 or len(set(a)) < 2 or len(set(b)) < 2 else np.corrcoef(a, b)[0, 1]
        assert (np.isnan(want) and np.isnan(got[i])) or abs(want - got[i]) < 1e-9


def test_pairs_are_aligned_by_time(spark):
    rows = [(i, "a", 10.0 * i, float(i % 5)) for i in range(30)] + [(100 + i, "b", 10.0 * i, float(i % 5) if i < 20 else 4.0 - i % 5) for i in range(30) if i != 7]
    rows += [(500, "c", 0.0, 1.0), (501, "a", 300.0, None)]
    df = spark.createDataFrame(rows, "reading bigint, sensor string, at double, v double")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0)], "a string, b string, expected double")
    got = {r.reading: r.fault.magnitude for r in detect.decoupled(df, pairs, (), "sensor", "reading", "at", "v").collect()}
    a = {r[2]: r[3] for r in rows if r[1] == "a" and r[3] is not None}
    want = {}
    seen = {"a": {}, "b": {}}
    for reading, sensor, at, v in sorted((r for r in rows if r[1] != "c" and r[3] is not None), key=lambda r: (r[2], r[1])):
        seen[sensor][at] = v
        both = [t for t in seen["a"] if t in seen["b"]]
        if len(both) >= 3:
            far = abs(np.corrcoef([a[t] for t in both], [seen["b"][t] for t in both])[0, 1] - 1)
            if far > 0.3:
                want[reading] = far
    assert got.keys() == want.keys() and len(got) > 5 and all(got[k] == pytest.approx(want[k]) for k in got)


def test_alert_ids_are_the_fixed_ones(spark):
    judged = spark.sql(
        """SELECT 'r1' AS reading, array(named_struct('fault_type', 'drift_correlated', 'detector', 'CrossCorrelationChecker'),
        named_struct('fault_type', 'drift_correlated', 'detector', 'CrossCorrelationChecker')) AS faults"""
    )
    got = [(r.alert_id, r.occurrence) for r in detect.alerts(judged, "reading").orderBy("occurrence").collect()]
    key = "r1|drift_correlated|CrossCorrelationChecker"
    assert got == [(str(uuid.uuid5(detect.ALERTS, key)), 0), (str(uuid.uuid5(detect.ALERTS, key + "|1")), 1)]

def test_uuid5(spark):
    keys = ["a|b", "", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", scalar.uuid5(F.col("k")).alias("u"))
    assert {r["k"]: r["u"] for r in df.collect()} == {k: str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys}


def test_adc_counts_truncate_and_clamp(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (99.999,), (200.0,), (-5.0,), (None,)], "v double")
    got = [r[0] for r in df.select(scalar.adc_counts(F.col("v"), F.lit(0.0), F.lit(100.0))).collect()]
    assert got == [0, 32767, 65534, 65535, 0, None]


def test_grid_value_is_bilinear_and_stays_on_the_grid(spark):
    table = [[0.0, 10.0], [20.0, 30.0], [40.0, 50.0]]
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (4.0, 1.0), (4.1, 0.0), (-1.0, 0.0)], "x double, y double")
    got = [r[0] for r in df.select(scalar.grid_value(table, F.col("x"), F.col("y"), 0.0, 2.0, 0.0, 1.0)).collect()]
    assert got == [0.0, 15.0, 50.0, None, None]


def brute_filter(values, seconds, q=1e-6, r=1.0):
    x = p = at = None
    out = []
    for v, s in zip(values, seconds, strict=True):
        if v is None:
            out.append((None, None))
            continue
        if x is None:
            x, p, at = np.array([v, 0.0]), np.eye(2) * 1000, s
            out.append((0.0, np.sqrt(1001)))
            continue
        dt, at = s - at, s
        f = np.array([[1, dt], [0, 1]])
        x, p = f @ x, f @ p @ f.T + q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
        res, var = v - x[0], p[0, 0] + r
        gain = p[:, 0] / var
        x, p = x + gain * res, (np.eye(2) - np.outer(gain, [1, 0])) @ p
        p = (p + p.T) / 2
        if abs(res / np.sqrt(var)) > 10:
            x, p = np.array([v, 0.0]), np.eye(2) * 1000
        out.append((res, np.sqrt(var)))
    return out


def test_filter_is_the_textbook_one(spark):
    rng = np.random.default_rng(1)
    rows = []
    for sensor in "ab":
        walk = np.cumsum(rng.normal(size=80)) + (sensor == "b") * np.where(np.arange(80) > 40, 500, 0)
        rows += [(sensor, i, float(180 * i), None if i % 9 == 4 else float(v)) for i, v in enumerate(walk)]
    df = spark.createDataFrame(rows, "sensor string, step bigint, s double, v double")
    got = kalman.run_filter(df, ["sensor"], ["step"], "s", "v").toPandas()
    for sensor in "ab":
        mine = got[got.sensor == sensor].sort_values("step")
        want = brute_filter([r[3] for r in rows if r[0] == sensor], [r[2] for r in rows if r[0] == sensor])
        assert np.allclose(mine.residual.to_numpy(float), [np.nan if a is None else a for a, _ in want], equal_nan=True)
        assert np.allclose(mine.sigma.to_numpy(float), [np.nan if b is None else b for _, b in want], equal_nan=True)


def test_filter_refuses_time_going_back(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 1.0), ("a", 1, 5.0, 1.0)], "sensor string, step bigint, s double, v double")
    with pytest.raises(Exception, match="go back in time"):
        kalman.run_filter(df, ["sensor"], ["step"], "s", "v").collect()


def test_feature_table_has_28_features_and_does_not_cross_runs(spark):
    assert len(features.feature_names()) == 28
    rows = [(run, i, tag, f"2024-01-01 00:{i:02d}:00", float(i + 100 * run), "position" if tag == "p" else "flow") for run in (0, 1) for i in range(12) for tag in "pq"]
    df = spark.createDataFrame(rows, "run_id int, step bigint, sensor string, at string, value double, kind string").withColumn("at", F.col("at").cast("timestamp"))
    got = features.feature_table(df, "run_id", "sensor", "step", "at", "value", "kind", 60.0).toPandas()
    assert len(got) == len(rows)
    assert set(features.feature_names()) < set(got)
    first = got[got.step == 0]
    assert first.lag_1.isna().all() and first.mean_10.isna().all() and (first.kalman_residual == 0).all()
    last = got[(got.step == 11) & (got.run_id == 1) & (got.sensor == "q")].iloc[0]
    assert last.slope_10 == pytest.approx(1 / 60) and last.mean_10 == pytest.approx(106.5) and last.power_level_pct == 111.0


def _features_of(spark, rows):
    df = spark.createDataFrame(rows, "run_id int, step bigint, sensor string, at string, value double, kind string").withColumn("at", F.col("at").cast("timestamp"))
    return features.feature_table(df.coalesce(1), "run_id", "sensor", "step", "at", "value", "kind", 60.0).toPandas().sort_values("step")


def test_an_instants_mean_is_exact(spark):
    # Added up as doubles, ten tenths are 0.9999999999999999.
    got = _features_of(spark, [(0, 0, f"p{k}", "2024-01-01 00:00:00", 0.1, "position") for k in range(10)])
    assert (got.power_level_pct == 0.1).all()
    rows = [(0, 0, f"p{k}", "2024-01-01 00:00:00", v, "position") for k, v in enumerate([1e300, 3e300, None, 2e-20])]
    assert _features_of(spark, rows).power_level_pct.tolist() == [pytest.approx(4e300 / 3)] * 4


def test_equal_values_have_no_spread_and_a_windows_mean_is_added_up_from_the_oldest(spark):
    rows = [(0, i, "q", f"2024-01-01 00:{i:02d}:00", 0.1, "flow") for i in range(3)]
    got = _features_of(spark, rows)
    assert got.std_10[2] == 0.0 and got.variance_ratio.isna().all()
    values = [10.08, 6.98, 5.64, 19.13, 21.14, 52.4, 17.24, 15.36, 3.83, 1.8]  # their sum, from the oldest, is 153.60000000000005
    got = _features_of(spark, [(0, i, "q", f"2024-01-01 00:{i:02d}:00", v, "flow") for i, v in enumerate(values)])
    assert got.zero_crossing_rate_10[9] == pytest.approx(2 / 9)


def test_features_of_missing_readings(spark):
    rows = [(0, i, "q", f"2024-01-01 00:{i:02d}:00", v, "flow") for i, v in enumerate([1.0, 9.0, None, 9.0, float("inf"), 9.0, 9.0])]
    df = spark.createDataFrame(rows, "run_id int, step bigint, sensor string, at string, value double, kind string").withColumn("at", F.col("at").cast("timestamp"))
    got = features.feature_table(df, "run_id", "sensor", "step", "at", "value", "kind", 60.0).toPandas().sort_values("step")
    want = brute_filter([1.0, 9.0, None, 9.0, None, 9.0, 9.0], [60.0 * i for i in range(7)])
    ratio = [np.nan if a is None else a / b for a, b in want]
    assert np.allclose(got.kalman_residual, ratio, equal_nan=True) and got.kalman_residual[1] == pytest.approx(8 / np.sqrt(1001 + 3600 * 1000 + 1e-6 * 60**3 / 3))
    assert np.allclose(got.kalman_uncertainty, [np.nan if b is None else b for _, b in want], equal_nan=True)
    assert got.stuck_run_length.tolist() == [1, 1, 1, 1, 1, 1, 2]
    assert got.zero_crossing_rate_10.isna().tolist() == [True, True, True, False, False, False, False] and (got.zero_crossing_rate_10[3:] == 1).all()
    assert got.slope_10.isna().all() and got.mean_10[5] == 7.0 and got.power_level_pct.isna().all()


def test_features_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(run, i, tag, 60.0 * i, float(np.round(rng.normal(), 1)) if rng.random() > 0.1 else None, "position") for run in (0, 1) for tag in "pqr" for i in range(150)]
    df = spark.createDataFrame(rows, "run_id int, step bigint, sensor string, at double, value double, kind string").withColumn("at", F.col("at").cast("timestamp"))
    frames = []
    for n in ("10000", "7", "64"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got = features.feature_table(df, "run_id", "sensor", "step", "at", "value", "kind", 60.0, pairs=(("p", "q"),)).toPandas()
        frames.append(got.sort_values(["run_id", "sensor", "step"]).reset_index(drop=True))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(frames[0], frames[1])
    pd.testing.assert_frame_equal(frames[0], frames[2])
    mine = pd.DataFrame(rows, columns=["run_id", "step", "sensor", "at", "value", "kind"])
    for (run, tag), g in mine.groupby(["run_id", "sensor"]):
        f = frames[0][(frames[0].run_id == run) & (frames[0].sensor == tag)]
        v = g.value.reset_index(drop=True)
        for n in (10, 20, 60):
            w = v.rolling(n, min_periods=3)
            for name, x in (("mean", w.mean()), ("std", w.std()), ("min", w.min()), ("max", w.max())):
                assert np.allclose(f[f"{name}_{n}"], x, equal_nan=True)
        both = [mine[(mine.run_id == run) & (mine.sensor == t)].value.reset_index(drop=True) for t in "pq"]
        assert np.allclose(f["cross_correlation_p__q"], both[0].rolling(10, min_periods=3).corr(both[1]), equal_nan=True)


def test_spans_of_a_constant_are_one_wide(spark):
    got = spans.derive(series(spark, [5.0, 5.0]), "sensor", "v").first()
    assert (got.low, got.alarm_low, got.alarm_high, got.high) == (3.0, 4.8, 5.2, 7.0)


def test_all_faults_and_alerts(spark):
    values = [float(i % 3) for i in range(20)] + [500.0] + [1.0] * 20 + [None]
    df = series(spark, values).withColumns({"at": F.col("step") * 180.0, "quality": F.lit("good"), "reading": F.col("step")})
    df = spans.attach(df, spans.derive(df.where("step < 20"), "sensor", "v"), "sensor")
    judged = detect.all_faults(df, S, "v", "at")
    rows = judged.orderBy("step").collect()
    assert rows[-1].faults == [] and rows[-1].quality == "good"
    assert rows[20].quality == "bad" and {f.fault_type for f in rows[20].faults} >= {"noise_spike", "bias_out_of_range", "kalman_anomaly"}
    assert [r.step for r in rows if any(f.fault_type == "stuck" for f in r.faults)] == list(range(28, 41))
    found = detect.alerts(judged, "reading")
    assert found.count() == sum(len(r.faults) for r in rows)


def test_interval_labels_cross_bins(spark):
    df = series(spark, [0.0] * 30)
    ep = spark.createDataFrame([("a", 5, 12), ("a", 20, None), ("b", 0, 3)], "sensor string, start bigint, last bigint")
    got = labels.label(df, ep, ["sensor"], bin_steps=4)
    assert [r.step for r in got.where("start IS NOT NULL").orderBy("step").collect()] == [*range(5, 13), *range(20, 30)]
    assert got.count() == 30


def test_confusion_conventions(spark):
    none = spark.createDataFrame([("x", False, False)], "k string, predicted boolean, actual boolean")
    r = labels.confusion(none, ["k"]).first()
    assert (r.precision, r.recall, r.fpr) == (1.0, 1.0, 0.0)


def test_split_floors_and_never_mixes(spark):
    df = spark.range(11).select(F.lit("c").alias("c"), F.col("id").alias("step")).union(spark.createDataFrame([("d", 0)], "c string, step bigint"))
    got = splits.temporal_split(df, ["c"], "step")
    counts = {(r.c, r.split): r["count"] for r in got.groupBy("c", "split").count().collect()}
    assert counts == {("c", "train"): 7, ("c", "validation"): 1, ("c", "test"): 3, ("d", "test"): 1}
    assert all(r.holds for r in splits.order_holds(got, ["c"], "step").collect())


def test_apportion_keeps_the_total(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, weight double")
    assert {r.k: r.quota for r in splits.apportion(w, 100, ["k"]).collect()} == {"a": 34, "b": 33, "c": 33}


def test_as_of_ttl_bound_is_fresh(spark):
    q = spark.createDataFrame([("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 01:00:01"), ("b", "2024-01-01 00:00:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    f = spark.createDataFrame([("a", "2024-01-01 00:00:00", 7.0)], "k string, t string, x double").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.k, r.t.hour, r.t.second): r.x for r in store.as_of(q, f, ["k"], "t", ["x"], 3600).collect()}
    assert got == {("a", 1, 0): 7.0, ("a", 1, 1): None, ("b", 0, 0): None}


def test_checks(spark):
    df = series(spark, [0.0, 1.0, 2.0])
    assert checks.contiguous(df, ["sensor"], "step").first().contiguous
    assert not checks.contiguous(df.where("step <> 1"), ["sensor"], "step").first().contiguous
    good, bad = checks.split_valid(df, {"small": F.col("v") < 2})
    assert good.count() == 2 and bad.first().broken == ["small"]
    with pytest.raises(ValueError, match="missing"):
        checks.require(df, ["nope"])


def test_rules(spark):
    plant = rules.Plant(3000.0, 4, 20000.0, 1.0, [[5e3, 5e3]] * 2, [300.0, 400.0], 0.0, 500.0, 0.0, 200.0)
    rows = [("a", 0, 0.0, 320.0, 290.0, 5000.0, 5000.0, 5000.0, 155.0, 100.0, 100.0), ("a", 1, 1.0, 340.0, 345.0, -1.0, None, 5.0, 900.0, 50.0, 100.0)]
    names = "sensor string, step bigint, s double, t_out double, t_in double, flow double, flow_hot double, flow_cold double, p double, flux double, p_th double"
    got = rules.margins(spark.createDataFrame(rows, names), plant, S, "s").orderBy("step").collect()
    assert got[0].temperature_ordering == 30.0 and got[0].boiling == pytest.approx(300 + 77.5 - 320) and got[0].heating_rate is None
    assert got[0].energy_balance == pytest.approx(0.05 - abs(3000 - 4 * 5000 * 5e3 * 30e-6) / 3000)
    assert got[1].temperature_ordering < 0 and got[1].flow_range < 0 and got[1].power_flux < 0 and got[1].heating_rate < 0
    assert got[1].boiling is None and got[1].mass_balance is None
    report = {r.rule: r for r in rules.report(spark.createDataFrame(rows, names), {"o": F.col("t_out") - F.col("t_in"), "n": F.lit(None)}, []).collect()}
    assert (report["o"].n_violations, report["o"].rate, report["n"].rate) == (1, 0.5, None)


def test_coverage_gate(spark):
    kinds = spark.createDataFrame([("a",), ("b",)], "k string")
    levels = spark.createDataFrame([(1,), (2,)], "l int")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, l int")
    cells = coverage.covered(coverage.grid(k=kinds, l=levels), rows, ["k", "l"])
    assert coverage.gate(cells, 0.5).first() == (0.5, True)


def test_injected_values_and_labels(spark):
    df = series(spark, [float(i) for i in range(10)])
    ep = spark.createDataFrame([("a", "freeze", 2, 4, 0.0), ("a", "spike", 6, 7, 100.0)], "sensor string, kind string, start bigint, last bigint, magnitude double")
    got = inject.inject(df, ep, "sensor", "step", "v").orderBy("step").toPandas()
    assert got.v.tolist() == [0, 1, 2, 2, 2, 5, 106, 7, 8, 9]
    assert got.label.tolist() == [None, None, None, "stuck", "stuck", None, "noise_spike", None, None, None]
    assert isinstance(got, pd.DataFrame)


def test_disjoint_merge_refuses_shared_keys(spark):
    a, b = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "k string, n int"), spark.createDataFrame([("s", 3)], "k string, n int")
    assert sorted(r.n for r in labels.merge_disjoint(a, b, ["k", "n"]).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="in both: s, 2"):
        labels.merge_disjoint(a, b.unionByName(a.where("n = 2")), ["k", "n"]).count()


def test_mismatched_names_all_three(spark):
    listed = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z"), ("d", 4, "w")], "path string, n int, digest string")
    there = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("d", 4, "v"), ("e", 5, "u")], "path string, n int, digest string")
    got = {r.path: r.what for r in checks.mismatched(listed, there, ["path"], ["n", "digest"]).collect()}
    assert got == {"c": "missing", "d": "differs", "e": "extra"}


def test_single_channel_replaces_its_role(spark):
    roles = spark.createDataFrame([(1, "hot"), (2, "hot"), (3, "cold")], "channel int, role string")
    assert sorted((r.channel, r.role) for r in rules.single(roles, 1).select("channel", "role").collect()) == [(1, "hot"), (3, "cold")]


def test_ranks_survive_outliers_ties_and_nulls(spark):
    rows = [("a", 1e12), *[("a", float(i)) for i in range(300)], ("b", 5.0), ("c", -1.0), ("c", -2.0)]
    df = spark.createDataFrame(rows, "k string, step double")
    got = {(r.k, r.step): (r["__r"], r["__n"]) for r in splits.ranked(df, ["k"], "step").collect()}
    assert got == {("a", 1e12): (300, 301), **{("a", float(i)): (i, 301) for i in range(300)}, ("b", 5.0): (0, 1), ("c", -1.0): (1, 2), ("c", -2.0): (0, 2)}
    whole = splits.ranked(df.select(F.col("step").cast("bigint").cast("timestamp").alias("at"), "k").where("k = 'c'"), ["k"], "at").orderBy("at").collect()
    assert [r["__r"] for r in whole] == [0, 1]


def test_runs_end_to_end_in_the_order_of_names(spark):
    names = [str(i) for i in range(0, 3000, 7)] + ["x", "", "abcd"]
    got = store.end_to_end(spark.createDataFrame([(n, len(n) + 2) for n in names], "run string, n int"), "run", "n")
    want, at = {}, 0
    for n in sorted(names, key=lambda n: (len(n), n)):
        want[n], at = at, at + len(n) + 3
    assert {r.run: r.offset for r in got.collect()} == want


def test_latest_rows_are_merged_by_version(spark, tmp_path):
    rows = [spark.createDataFrame(x, "k string, at int, tie int, v int") for x in ([("a", 1, 0, 1), ("b", 5, 0, 2)], [("a", 2, 0, 3), ("b", 4, 0, 4)])]
    store.materialize(rows[0], str(tmp_path), ["k"], "at", "tie", 0)
    for _ in range(2):
        got = store.materialize(rows[1], str(tmp_path), ["k"], "at", "tie", 1)
        assert {r.k: r.v for r in got.collect()} == {"a": 3, "b": 2}


def test_any_channel_breaks_a_rule(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 50.0), ("c", 1, None)], "sensor string, step bigint, v double")
    hot = rules.heating_margins(df, S, "v", "step", 10.0, ["step"])
    assert {r.step: r.heating_rate for r in hot.collect()} == {0: None, 1: -39.0}
    assert {r.step: r.flow_range for r in rules.flow_margins(df, "v", 80.0, 2, ["step"]).collect()} == {0: 1.0, 1: -10.0}


def test_sensors_are_resolved_or_refused(spark):
    df = spark.createDataFrame([("b", "flow"), ("a", "flow"), ("c", "pressure"), ("a", "flow"), ("d", "flow")], "sensor_id string, sensor_type string")
    assert checks.resolve_sensors(df, ["flow"], ["d"], 2) == ["a", "b"]
    for n in (1, 3):
        with pytest.raises(ValueError, match="expected"):
            checks.resolve_sensors(df, ["flow"], ["d"], n)


def test_dimension_names_its_first_defect(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("b", 2)], "id string, x int")
    with pytest.raises(ValueError, match="a: positive"):
        checks.sound(df, {"positive": F.col("x") > 0}, "id")
    with pytest.raises(ValueError, match="b: repeated"):
        checks.sound(df.where("x > 0"), {"positive": F.col("x") > 0}, "id")


def test_times_without_a_zone(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01 05:00:00' AS a, timestamp '2024-01-01 05:00:00+02:00' AS b")
    with pytest.raises(ValueError, match="zone"):
        scalar.utc(df, "a")
    assert scalar.utc(df, "a", "utc").select(F.unix_micros("a")).first()[0] == 1704085200_000_000
    assert scalar.utc(df, "b") is df


def test_aliases_and_curves(spark):
    df = spark.createDataFrame([(180.0,), (270.0,), (100.0,), (0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(scalar.aliased_period(F.col("x"), 180.0)).collect()]
    assert got[0] is None and got[1] == pytest.approx(540.0) and got[2] == pytest.approx(900.0) and got[3:] == [None, None]
    assert [r[0] for r in df.select(scalar.curve([100.0, 200.0], [1.0, 2.0], F.col("x"))).collect()] == [1.8, None, 1.0, None, None]


def test_dense_cells(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "step int, sensor string, v double")
    got = {(r.step, r.sensor): r.v for r in coverage.dense(df, ["step"], "sensor", ["a", "b"]).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): None, (2, "a"): None, (2, "b"): 2.0}


def test_intermittent_starts_lost_at_its_rail_and_toggles(spark):
    df = spark.range(4000).select(F.lit("s").alias("sensor"), F.col("id").alias("step"), F.lit(5.0).alias("v"))
    ep = spark.createDataFrame([("s", 10, 3009, 1.0, 0.2, 0.3, 0.0, 9.0)], "sensor string, start long, last long, direction double, p_enter double, p_exit double, low double, high double")
    got = inject.intermittent(df, ep, "sensor", "step", "v", 7).orderBy("step").toPandas()
    assert not got.invalid[:10].any() and not got.invalid[3010:].any() and got.invalid[10] and got.v[10] == 9.0
    inside = got[10:3010]
    assert (inside.v[~inside.invalid] == 5.0).all() and set(inside.v[inside.invalid]) == {0.0, 9.0} and (got.true_value == 5.0).all()
    was, now = inside.invalid.to_numpy()[:-1], inside.invalid.to_numpy()[1:]
    assert abs((~now[was]).mean() - 0.3) < 0.04 and abs(now[~was].mean() - 0.2) < 0.04
    rail = inside.v.to_numpy()
    assert (rail[1:][was & now] == rail[:-1][was & now]).all()


def test_noise_is_gaussian_and_repeats(spark):
    df = spark.range(20000).select(F.col("id").alias("step"), F.lit(1.0).alias("v"))
    made = inject.noisy(df, ["step"], "v", F.lit(2.0), 3)
    x = np.array([r.v for r in made.orderBy("step").collect()])
    assert abs(x.mean() - 1) < 0.05 and abs(x.std() - 2) < 0.05
    again = np.array([r.v for r in made.repartition(7).orderBy("step").collect()])
    assert (x == again).all()


def test_a_gate_needs_all_kinds(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "kind string, covered boolean")
    assert coverage.typed_gate(df, 0.3, "kind", 1).first().passed and not coverage.typed_gate(df, 0.3, "kind", 2).first().passed


def lines(spark, sensors=30, steps=200, runs=2):
    return spark.createDataFrame([(f"r{k}", f"s{i}", steps + 10 * k) for k in range(runs) for i in range(sensors)], "run string, sensor string, n bigint")


def test_episodes_are_placed_apart(spark):
    """Disjoint sensors for each kind, one episode in each segment with its guard, the same for any partitioning."""
    df, plan = lines(spark), placement.Plan(sensors_per_kind=5, episodes_per_sensor=3)
    placed = [sorted(map(tuple, placement.episodes(x, ["run"], "sensor", "n", plan, 9).collect())) for x in (df, df.repartition(7), df.coalesce(1).orderBy(F.desc("sensor")))]
    assert placed[0] == placed[1] == placed[2] and len(placed[0]) == 2 * 4 * 5 * 3
    kinds = {}
    for run, sensor, kind, episode, start, last, direction in placed[0]:
        kinds.setdefault((run, sensor), set()).add(kind)
        segment = (200 if run == "r0" else 210) // 3
        low, high = plan.lengths[kind]
        assert low <= last - start + 1 <= high and direction in (-1.0, 1.0)
        assert episode * segment + 3 <= start and last < (episode + 1) * segment - 3
    assert all(len(k) == 1 for k in kinds.values())
    per = [list(kinds.values()).count({k}) for k in plan.lengths]
    assert per == [10] * 4 and {s for r, s in kinds if r == "r0"} != {s for r, s in kinds if r == "r1"}
    other = placement.episodes(df, ["run"], "sensor", "n", plan, 10).collect()
    assert sorted(map(tuple, other)) != placed[0]


def test_placement_says_what_does_not_fit(spark):
    with pytest.raises(Exception, match="24 sensors with a span are needed, there are 20"):
        placement.episodes(lines(spark, 20), ["run"], "sensor", "n", placement.Plan(), 1).collect()
    with pytest.raises(Exception, match="doesn't fit its segment of 20"):
        placement.episodes(lines(spark, 30, 40, 1), ["run"], "sensor", "n", placement.Plan(), 1).collect()
    with pytest.raises(ValueError):
        placement.Plan(lengths={"freeze": (3, 2)})


def test_permutation_is_one(spark):
    df = spark.range(5000).selectExpr("id % 3 AS k", "id")
    got = placement.permuted(df, ["k"], ["id"], 4).toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g["place"]) == list(range(len(g))) and list(g.sort_values("id")["place"]) != list(range(len(g)))
    # A place's neighbours are far apart: ranks are like uniform draws.
    assert abs(np.corrcoef(got["id"], got["place"])[0, 1]) < 0.05
    assert placement.permuted(df.where("false"), ["k"], ["id"], 4).count() == 0


def test_offsets_leave_the_envelope_and_faults_are_found(spark):
    """From placement to detection: an injected offset is out of range at every step of its window, a freeze is stuck."""
    rng = np.random.default_rng(1)
    rows = [(f"s{i:02d}", t, float(v)) for i in range(24) for t, v in enumerate(rng.normal(50, 1, 400))]
    readings = spark.createDataFrame(rows, "sensor string, step bigint, v double")
    span = spans.derive(readings, "sensor", "v")
    plan = placement.Plan()
    placed = placement.episodes(readings.groupBy("sensor").agg(F.count("*").alias("n")), [], "sensor", "n", plan, 3)
    known = placement.sized(placed, readings, span, [], "sensor", "step", "v", 180.0, plan, 3)
    changed = inject.inject(readings, known, "sensor", "step", "v")
    attached = spans.attach(changed.withColumns({"s": F.col("step") * 180.0, "quality": F.lit("good")}), span, "sensor")
    judged = detect.all_faults(attached, S, "v", "s")
    truth = placement.truth(known.withColumn("end", F.lit(399)), ["sensor"], "end")
    found = judged.select("sensor", "step", F.explode("faults.fault_type").alias("fault_type")).distinct()
    hit = truth.join(found, ["sensor", "step", "fault_type"]).groupBy("fault_type").count()
    hits, all_of = dict(map(tuple, hit.collect())), dict(map(tuple, truth.groupBy("fault_type").count().collect()))
    assert hits["stuck"] / all_of["stuck"] > 0.6 and hits["noise_spike"] / all_of["noise_spike"] > 0.6
    offsets = known.where("kind = 'offset'").select("sensor", F.explode(F.sequence("start", "last")).alias("step"))
    assert offsets.join(found.where("fault_type = 'bias_out_of_range'"), ["sensor", "step"], "left_anti").count() == 0
    assert known.where("kind = 'spike' AND abs(widths) NOT BETWEEN 1.5 AND 4").count() == 0


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k string, at bigint, tie bigint, v int")


def test_merges_rewrite_their_buckets_alone_and_lookups_read_theirs(spark, tmp_path):
    path = str(tmp_path / "latest")
    store.materialize(keyed(spark, [(f"k{i}", 1, 0, i) for i in range(200)]), path, ["k"], "at", "tie", 0, 16)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    got = store.materialize(keyed(spark, [("k7", 2, 0, -7), ("k8", 0, 0, -8), ("new", 1, 0, 1)]), path, ["k"], "at", "tie", 1)
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 3
    assert {r.k: r.v for r in got.collect()} == {f"k{i}": i for i in range(200)} | {"k7": -7, "new": 1}
    asked = spark.createDataFrame([("k7",), ("nobody",)], "k string")
    found = store.lookup(asked, path)
    assert {r.k: r.v for r in found.collect()} == {"k7": -7, "nobody": None}
    whole = {r.k: r.v for r in store.lookup(asked, path, 0).collect()}
    assert whole["k7"] == 7
    read = {f.rsplit("/", 1)[-1] for f in found.inputFiles()}
    assert 1 <= len(read) <= 2 < 16 and store.versions(spark, path) == [0, 1]


def test_versions_that_are_not_complete_are_refused(spark, tmp_path):
    path = str(tmp_path / "latest")
    with pytest.raises(ValueError, match="version 1 is not there"):
        store.materialize(keyed(spark, [("a", 1, 0, 1)]), path, ["k"], "at", "tie", 2)
    with pytest.raises(ValueError, match="not there"):
        store.lookup(keyed(spark, []).select("k"), path)
    store.materialize(keyed(spark, []), path, ["k"], "at", "tie", 0)
    assert store.lookup(keyed(spark, [("a", 1, 0, 1)]).select("k"), path).collect()[0].v is None
    with pytest.raises(ValueError, match="other keys"):
        store.materialize(keyed(spark, [("a", 1, 0, 1)]), path, ["k", "v"], "at", "tie", 1)


def test_sets_of_ids_add_up(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], int(i % 3), int(rng.integers(0, 90_000)), None if i % 11 == 0 else int(rng.integers(0, 40)), i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "part string, kind int, episode bigint, run bigint, bad bigint")
    scopes = [["part", "kind"], ["part"], []]
    sets = coverage.id_sets(df, ["part", "kind"], {"episodes": "episode", "runs": "run"}, {"bad": F.col("bad")})
    got = {(r.scope, r.part, r.kind): (r.n_rows, r.bad, r.n_episodes, r.n_runs) for r in coverage.scoped(sets, ["part", "kind"], scopes, ["episodes", "runs"], ["bad"]).collect()}
    want = {}
    for k, scope in enumerate(scopes):
        for part, kind, episode, run, bad in rows:
            cell = want.setdefault((k, part if "part" in scope else None, kind if "kind" in scope else None), [0, 0, set(), set()])
            cell[0] += 1
            cell[1] += bad
            cell[2].add(episode)
            if run is not None:
                cell[3].add(run)
    assert got == {k: (n, bad, len(e), len(r)) for k, (n, bad, e, r) in want.items()}
    assert coverage.scoped(coverage.id_sets(df.where("false"), ["part", "kind"], {"runs": "run"}, {}), ["part", "kind"], scopes, ["runs"], []).where("n_rows > 0").count() == 0


def test_dimensions_that_name_each_other(spark):
    plants = spark.createDataFrame([("p1", None, 0.0, 10.0), ("p2", "p1", 0.0, 5.0), ("p3", "p2", 0.0, 5.0)], "id string, owner string, low double, high double")
    sensors = spark.createDataFrame([("s1", "p1", 9.0), ("s2", "p2", 4.0), ("s3", None, 1.0)], "id string, plant string, x double")

    def dims(plants=plants, sensors=sensors):
        return {
            "plants": checks.Dimension(plants, "id", {"span": F.col("low") < F.col("high")}, {"owner": "plants"}, parent="owner"),
            "sensors": checks.Dimension(sensors, "id", {}, {"plant": "plants"}, {"x": ("plant", "low", "high")}),
        }

    checks.whole(dims())
    cases = {
        "sensors s4: orphan .plant p9.": dims(sensors=sensors.union(spark.createDataFrame([("s4", "p9", 1.0)], sensors.schema))),
        "sensors s4: out_of_range .x 7.0.": dims(sensors=sensors.union(spark.createDataFrame([("s4", "p2", 7.0)], sensors.schema))),
        "sensors s1: repeated .2.": dims(sensors=sensors.union(spark.createDataFrame([("s1", "p1", 1.0)], sensors.schema))),
        "plants None: absent_key": dims(plants=plants.union(spark.createDataFrame([(None, None, 0.0, 1.0)], plants.schema))),
        "plants p4: rule .span.": dims(plants=plants.union(spark.createDataFrame([("p4", None, 2.0, 1.0)], plants.schema))),
        "plants p4: cyclic .owner.": dims(plants=plants.union(spark.createDataFrame([("p4", "p5", 0.0, 1.0), ("p5", "p4", 0.0, 1.0), ("p6", "p5", 0.0, 1.0)], plants.schema))),
        "plants p4: orphan .owner p0.": dims(plants=plants.union(spark.createDataFrame([("p4", "p0", 0.0, 1.0)], plants.schema)), sensors=sensors.union(spark.createDataFrame([("s4", "p9", 1.0)], sensors.schema))),
    }
    for message, case in cases.items():
        with pytest.raises(ValueError, match=message):
            checks.whole(case)


def two_axes(spark, episodes):
    rows = [(run, sensor, step, f"2024-01-01 00:{step:02d}:00", float(step), float(step) + (run == "b" and sensor == "s2" and step > 4)) for run in "ab" for sensor in ("s1", "s2") for step in range(10)]
    readings = spark.createDataFrame(rows, "run_id string, sensor_id string, timestep bigint, timestamp string, true_value double, value double")
    planned = spark.createDataFrame(episodes, "run_id string, sensor_id string, fault string, level string, start bigint, last bigint")
    return dataset.assemble(readings, planned)


def test_both_axes_are_labelled(spark):
    """A process fault labels all sensors, an instrument's its own; where both are, the instrument's episode names the row."""
    got = two_axes(spark, [("a", None, "void_formation", "deep", 6, None), ("b", "s2", "drift", "slow", 4, 7), ("b", None, "core_temp_excursion", "one", 7, 8), ("c", "s1", "bias", "x", 0, 1)])
    rows = {(r.run_id, r.sensor_id, r.timestep): r for r in got.collect()}
    assert len(rows) == 40 and got.columns[-1] == "labelled"
    assert all((r.process_fault == "void_formation") == (t >= 6) for (run, _, t), r in rows.items() if run == "a")
    r = rows["b", "s2", 7]
    assert (r.process_fault, r.process_severity, r.instrument_fault, r.instrument_severity, r.fault_level, r.injected_at_step, r.injected_at) == (
        "core_temp_excursion", "critical", "drift", "high", "slow", 4, "2024-01-01 00:04:00",
    )
    assert rows["b", "s1", 7].episode_id == "b/core_temp_excursion/7" and rows["b", "s1", 4].instrument_fault == "none"
    assert {k for k, r in rows.items() if r.corrupted} == {("b", "s2", t) for t in (5, 6, 7)}
    assert sum(r.labelled for r in rows.values()) == 8 + 4 + 3
    assert {(r.severity, r.readings, r.fraction) for r in dataset.by_severity(got).collect()} == {("low", 0, 0.0), ("medium", 0, 0.0), ("high", 4, 0.1), ("critical", 11, 0.275)}
    whole = dataset.by_scenario(got.withColumn("scenario", F.col("run_id"))).where("scenario IS NULL").first()
    assert (whole.runs, whole.readings, whole.labelled, whole.corrupted, whole.episodes) == (2, 40, 15, 3, 3)
    assert dataset.by_severity(got.where("false")).where("readings > 0 OR fraction > 0").count() == 0


def test_overlapping_episodes_are_refused(spark):
    with pytest.raises(Exception, match="overlapping episodes: a, s1, 3"):
        two_axes(spark, [("a", "s1", "drift", "x", 0, 3), ("a", "s1", "bias", "x", 3, 5)]).collect()
    assert two_axes(spark, [("a", "s1", "drift", "x", 0, 3), ("a", "s2", "bias", "x", 3, 5)]).where("labelled").count() == 7
    assert two_axes(spark, []).where("labelled OR corrupted").count() == 0


def test_rows_without_a_step_or_class_have_no_split(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("a", None), (None, 3)], "c string, step bigint")
    got = splits.temporal_split(df, ["c"], "step").collect()
    assert len(got) == 12 and sum(r.split is None for r in got) == 2 and {r.step for r in got if r.split == "test"} == {8, 9}


def test_feature_views(spark, tmp_path):
    view = views.FeatureView("levels", ttl=60.0, features=("x", "y"))
    rows = spark.createDataFrame(
        [("s1", "2024-01-01 00:00:00", "2024-01-02", 1.0, 1.0), ("s1", "2024-01-01 00:00:00", "2024-01-03", 2.0, 1.0), ("s1", "2024-01-01 00:05:00", "2024-01-02", 3.0, None), ("s2", "2024-01-01 00:00:30", "2024-01-02", 4.0, 4.0)],
        "sensor_id string, event_timestamp string, created_timestamp string, x double, y double",
    )
    assert view.source(rows).count() == 3 and view.source(rows).schema == view.schema
    asked = spark.createDataFrame([("s1", "2024-01-01 00:01:00"), ("s1", "2024-01-01 00:01:01"), ("s2", "2024-01-01 00:00:00"), ("s3", "2024-01-01 00:00:00")], "sensor_id string, event_timestamp string").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    got = {(r.sensor_id, str(r.event_timestamp)[14:]): r.x for r in view.history(asked, rows).collect()}
    assert got == {("s1", "01:00"): 2.0, ("s1", "01:01"): None, ("s2", "00:00"): None, ("s3", "00:00"): None}
    service = views.FeatureService("all", ((view, ("y",)), (views.FeatureView("others", 600.0, features=("x", "y")), ("x",))))
    both = {(r.sensor_id, str(r.event_timestamp)[14:]): (r.y, r.x) for r in service.history(asked, {"levels": rows, "others": rows}).collect()}
    assert both["s1", "01:01"] == (None, 2.0)
    view.register(rows)
    assert spark.sql("SELECT max(x) AS x FROM levels").first().x == 4.0
    view.materialize(rows, str(tmp_path / "t"), 0)
    now = F.lit("2024-01-01 00:05:30").cast("timestamp")
    found = {r.sensor_id: (r.x, r.verdict) for r in view.online(asked.select("sensor_id").distinct(), str(tmp_path / "t"), now).collect()}
    assert found == {"s1": (3.0, "fresh"), "s2": (4.0, "stale"), "s3": (None, "missing")}
    with pytest.raises(ValueError, match="missing columns: y"):
        view.source(rows.drop("y"))
    with pytest.raises(ValueError):
        views.FeatureView("v", 0.0)
    assert len(views.FeatureView("all", 1.0).schema) == 31

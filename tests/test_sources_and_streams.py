"""Sources, sinks and streams; a stream's verdicts are those of the batch."""

import hashlib
import json
import pathlib
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxgauge.functions.windows import Series
from fluxgauge.operators import detect, sketches, spans, tracks
from fluxgauge.sources import archive, kafka, port, readings, reports, runs, text_matrix, versioned
from fluxgauge.streaming import judge, loop, telemetry, windows


def test_text_matrix_turns_and_refuses(spark, tmp_path):
    (tmp_path / "d00.dat").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "d01.dat").write_text(" 1.5 2\n 3 4\n5 6 \n7 8\n")
    got = text_matrix.read(spark, str(tmp_path), 2)
    assert {(r.file_class, r.step, r.channel): r.value for r in got.where("file_class = 0").collect()} == {
        (0, s, c): float(1 + s + 3 * c) for s in range(3) for c in range(2)
    }
    assert got.where("file_class = 1 AND step = 2").count() == 2
    named = text_matrix.adapt(got, "P", "2024-01-01 00:00:00", 180, 1).where("file_class = 1 AND step = 3").orderBy("channel").collect()
    assert [r.sensor_id for r in named] == ["P-XMEAS-01", "P-XMV-01"] and named[0].timestamp.minute == 9
    (tmp_path / "d02.dat").write_text("1 2 3\n4 5 6\n7 8 9\n")
    with pytest.raises(Exception, match="not a matrix"):
        text_matrix.read(spark, str(tmp_path), 2).collect()


def message(**changed):
    base = {
        "reading_id": "r1", "timestamp": "2024-01-01T00:00:00Z", "plant_id": "P-1",
        "sensor": {"id": "S1", "type": "flow", "location": "core", "elevation_m": 1.0},
        "measurement": {"value": 1.0, "unit": "kg_s", "quality": "good", "raw_counts": 5},
        "metadata": {"calibration_date": "2024-01-01", "last_maintenance": "2024-01-01", "drift_coefficient": 0.0},
    }
    return json.dumps(base | changed)


def test_poison_goes_to_quarantine(spark):
    sensor = {"id": "S1", "type": "odd", "location": "core", "elevation_m": 500.0}
    rows = [(0, message()), (1, None), (2, "not json"), (3, message(sensor=sensor))]
    good, bad = readings.parse(spark.createDataFrame(rows, "offset bigint, value string"))
    assert [r.offset for r in good.collect()] == [0] and good.first().is_usable
    assert {r.offset: r.broken for r in bad.collect()} == {1: ["tombstone"], 2: ["not_json"], 3: ["sensor_type", "elevation"]}
    again, _ = readings.parse(readings.encode(good).select("value"))
    assert again.first().measurement.raw_counts == 5
    assert readings.numbers(good).first().value == 1.0


def test_archive_appends_once_and_prunes(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(f"r{i}", f"2024-01-01 {i // 2:02d}:{30 * (i % 2):02d}:00", "P1", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "reading_id string, timestamp string, plant_id string, v double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    archive.append(spark, df, path)
    archive.append(spark, df.union(df), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 10
    got = archive.read_range(stored, "P1", "2024-01-01 01:30:00", "2024-01-01 03:00:00")
    assert [r.reading_id for r in got.collect()] == ["r3", "r4", "r5"]
    assert "PartitionFilters" in got._jdf.queryExecution().toString()


def hours_of(spark, low, high):
    rows = [(f"r{i}", f"2024-01-01 {i // 20:02d}:{3 * (i % 20):02d}:00", "P 1/x", float(i)) for i in range(low, high)]
    return spark.createDataFrame(rows, "reading_id string, timestamp string, plant_id string, v double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_archive_answers_what_it_created(spark, tmp_path):
    path = str(tmp_path / "archive")
    first = {(r.hour, r.answer): r.added for r in archive.append(spark, hours_of(spark, 0, 50), path).collect()}
    assert first == {("00", "created"): 20, ("01", "created"): 20, ("02", "created"): 10}
    again = {(r.hour, r.answer): r.added for r in archive.append(spark, hours_of(spark, 30, 70), path).collect()}
    assert again == {("01", "existing"): 0, ("02", "created"): 10, ("03", "created"): 10}
    assert {r.answer for r in archive.append(spark, hours_of(spark, 0, 70), path).collect()} == {"existing"}
    stored = spark.read.parquet(path)
    assert stored.count() == 70 == stored.select("reading_id").distinct().count()
    assert archive.read_range(stored, "P 1/x", "2024-01-01 01:00:00", "2024-01-01 02:00:00").count() == 20
    assert archive.append(spark, hours_of(spark, 0, 0), path).count() == 0
    assert not list((tmp_path / "archive" / "_staging").iterdir())


def test_archive_appends_at_once(spark, tmp_path):
    """Four writers of overlapping batches leave each reading once, and their answers add up."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "archive")
    with ThreadPoolExecutor(4) as pool:
        told = list(pool.map(lambda k: archive.append(spark, hours_of(spark, 20 * k, 20 * k + 60), path).collect(), range(4)))
    stored = spark.read.parquet(path)
    assert stored.count() == 120 == stored.select("reading_id").distinct().count()
    assert sum(r.added for rows in told for r in rows) == 120


def test_a_killed_append_that_runs_again_adds_the_rest(spark, tmp_path, monkeypatch):
    path, claim, made = str(tmp_path / "archive"), archive._Folders.claim, []

    def dies(self, source, hour, n):
        if len(made) == 1:
            raise RuntimeError("killed")
        made.append(hour)
        return claim(self, source, hour, n)

    monkeypatch.setattr(archive._Folders, "claim", dies)
    with pytest.raises(RuntimeError, match="killed"):
        archive.append(spark, hours_of(spark, 0, 60), path)
    monkeypatch.setattr(archive._Folders, "claim", claim)
    assert spark.read.parquet(path).count() == 20
    answers = [r.answer for r in archive.append(spark, hours_of(spark, 0, 60), path).collect()]
    assert sorted(answers) == ["created", "created", "existing"]
    assert archive.append(spark, hours_of(spark, 0, 60), path).where("added > 0").count() == 0
    stored = spark.read.parquet(path)
    assert stored.count() == 60 == stored.select("reading_id").distinct().count()


def test_kafka_options():
    c = kafka.Connection("h:9092", "SASL_SSL", "u", "secret")
    assert "secret" not in repr(c) and kafka.source_options(c, "t")["startingOffsets"] == "earliest"
    assert kafka.sink_options(c, "t")["kafka.acks"] == "all"
    with pytest.raises(ValueError):
        kafka.Connection("h:9092", "SASL_SSL")


def test_kafka_header_last_wins(spark):
    df = spark.sql("SELECT array(named_struct('key','run-id','value',cast('a' AS binary)), named_struct('key','run-id','value',cast('b' AS binary))) AS headers")
    assert df.select(kafka.header("run-id", F.col("headers"))).first()[0] == "b"


def test_report_is_stable(spark):
    df = spark.createDataFrame([(2, float("nan")), (1, 0.5)], "k int, x double")
    assert reports.to_json(df, ["k"]) == json.dumps([{"k": 1, "x": 0.5}, {"k": 2, "x": None}], sort_keys=True, indent=2) + "\n"


def coarse_events(spark, sf):
    """Two runs of readings with missing values, and spans; the second run is the first, an hour later, of other values."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").cast("string").alias("sensor_id"), F.col("event_id").cast("string").alias("reading_id"), F.lit("run").alias("run_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
        F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 40).cast("double")).alias("value"), F.lit("good").alias("quality"),
    )
    return spans.attach(e, spans.derive(e.where("value < 2"), "sensor_id", "value"), "sensor_id")


def follow(spark, folder, work, parts, stop_after=None, **kw):
    """Judge the files of a folder, one a micro-batch, and write both outputs."""
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/part0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)

    def write(df, n):
        if stop_after is not None and n >= stop_after:
            raise RuntimeError("stopped")
        judge.write_both(df, f"{work}/valid", f"{work}/alerts", n)

    q = judge.judged(source, **kw).writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{work}/valid"), spark.read.parquet(f"{work}/alerts")


def test_stream_judges_as_batch_does(spark, sf, tmp_path):
    e = coarse_events(spark, sf)
    times = e.select(F.percentile("at", [0.3, 0.6]).alias("q")).first()[0]
    for k, (a, b) in enumerate([(0, times[0]), (times[0], times[1]), (times[1], 1e18)]):
        e.where((F.col("at") >= a) & (F.col("at") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    valid, alerts = follow(spark, f"{tmp_path}/in", tmp_path, 3)
    got = valid.toPandas().set_index("reading_id").sort_index()
    s = Series(("sensor_id",), ("at", "reading_id"))
    want = detect.all_faults(e, s, "value", "at").toPandas().set_index("reading_id").sort_index()
    assert len(got) == len(want) and got["resets"].sum() == 0
    assert got["quality"].tolist() == want["quality"].tolist()
    assert [list(x) for x in got["fault_types"]] == [[f["fault_type"] for f in x] for x in want["faults"]]
    assert [list(x) for x in got["severities"]] == [[f["severity"] for f in x] for x in want["faults"]]
    assert alerts.count() == sum(len(x) for x in want["faults"])
    made = detect.alerts(detect.all_faults(e, s, "value", "at"), "reading_id")
    assert {r.alert_id for r in alerts.collect()} == {r.alert_id for r in made.collect()}


def pair_runs(spark):
    """Two runs of three sensors at 0, 180, ... s: 2 follows 1 and then drifts off, 3 is noise; some values are missing."""
    rows, rng = [], __import__("random").Random(7)
    for run in ("r1", "r2"):
        for i in range(160):
            base = rng.random()
            for sensor, x in (("s1", base), ("s2", base * 2 + 0.01 * rng.random() if i < 90 else rng.random()), ("s3", rng.random())):
                value = None if rng.random() < 0.05 else float("nan") if rng.random() < 0.02 else x
                rows.append((sensor, f"{run}-{sensor}-{i:03d}", run, 180.0 * i, value, "good", -1.0, 0.0, 3.0, 4.0))
    schema = "sensor_id string, reading_id string, run_id string, at double, value double, quality string, low double, alarm_low double, alarm_high double, high double"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([("s1", "s2", 1.0), ("s3", "s1", 0.5)], "a string, b string, expected double")


def faults_of(frame):
    def number(x):
        return None if x is None else round(x, 9)

    return {
        r.reading_id: (r.quality, [(f.fault_type, f.severity, number(f.confidence), number(f.magnitude), {k: number(v) for k, v in f.evidence.items()}, f.sensors) for f in r.faults])
        for r in frame.select("reading_id", "quality", "faults").collect()
    }


def test_pairs_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Both runs, with missing values, in batches that cut and mix runs, over a stop and a restart."""
    e, pairs = pair_runs(spark)
    parts = [e.where("run_id = 'r1' AND at < 9000"), e.where("run_id = 'r1' AND at >= 9000 AND at < 20000"), e.where("(run_id = 'r1' AND at >= 20000) OR (run_id = 'r2' AND at < 4000)"), e.where("run_id = 'r2' AND at >= 4000")]
    for k, part in enumerate(parts):
        # Offsets are what a topic would give: a sensor's readings in the order of runs and time.
        order = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("sensor_id").orderBy("run_id", "at")
        part.withColumn("source_offset", F.lit(1000 * k) + F.row_number().over(order).cast("bigint")).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    with pytest.raises(Exception, match="stopped"):
        follow(spark, f"{tmp_path}/in", tmp_path, 4, stop_after=2, pairs=pairs)
    valid, alerts = follow(spark, f"{tmp_path}/in", tmp_path, 4, pairs=pairs)
    want = detect.all_faults(e, Series(("run_id", "sensor_id"), ("at", "reading_id")), "value", "at", pairs, "reading_id")
    got, expected = faults_of(valid), faults_of(want)
    assert got == expected
    apart = [f for _, found in got.values() for f in found if f[0] == "drift_correlated"]
    assert len(apart) > 50 and {tuple(f[5]) for f in apart} == {("s1", "s2"), ("s3", "s1")}
    assert valid.agg(F.sum("resets")).first()[0] == 3  # each sensor once, at the second run
    rows = alerts.select("alert_id", "detected_at", "at", "evidence", "run_id").collect()
    assert len({r.alert_id for r in rows}) == len(rows) == sum(len(f) for _, f in got.values())
    assert all(r.evidence and r.run_id and r.detected_at.timestamp() == r.at for r in rows)


def test_idle_pairs_are_forgotten(spark, tmp_path):
    """With a time to live a pair that comes back later starts anew."""
    import time

    e, pairs = pair_runs(spark)
    one = e.where("run_id = 'r1'")
    one.where("at < 9000").coalesce(1).write.parquet(f"{tmp_path}/in/part0")
    source = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    q = judge.judged(source, pairs, forget=1).writeStream.foreachBatch(lambda df, n: seen.extend((n, r.reading_id, len(r.faults)) for r in df.select("reading_id", F.filter("faults", lambda f: f["fault_type"] == "drift_correlated").alias("faults")).collect()))
    q = q.option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.5)
        time.sleep(3)
        first = len(seen)
        one.where("at >= 9000 AND at < 9000 + 2 * 180").coalesce(1).write.parquet(f"{tmp_path}/in/part1")
        while len(seen) == first and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert first == 150 and len(seen) == 156
    # Two instants are too few for a coefficient.
    assert any(n for _, _, n in seen[:first]) and not any(n for _, _, n in seen[first:])


def test_state_starts_anew_with_another_run():
    t = tracks.Track()
    assert [n[0] for n in t.follow([180.0 * i for i in range(9)], [1.0] * 9, [0.0] * 9)] == list(range(1, 10))
    again = tracks.Track(t.state())
    assert again.follow([180.0 * 9], [1.0], [0.0])[0][0] == 10 and tracks.Track().follow([0.0], [1.0], [0.0])[0][:3] == (1, None, None)


def test_replay_keeps_each_sensors_order(spark, tmp_path):
    """Whatever partition and task writes them, a sensor's records are in the order of runs and steps; runs don't overlap."""
    flat = spark.range(480).selectExpr(
        "concat('r', id) AS reading_id", "timestamp_seconds(180 * ((id div 8) % 30)) AS timestamp", "'P-1' AS plant_id", "concat('S', id % 8) AS sensor_id", "'flow' AS sensor_type",
        "'core' AS sensor_location", "1.0 AS elevation_m", "cast(id AS double) AS value", "'kg_s' AS unit", "'good' AS quality", "1 AS raw_counts", "if(id < 240, 'b-first', 'a-second') AS run_id",
    ).repartition(6)
    stored = readings.nested(flat.drop("run_id")).join(flat.select("reading_id", "run_id"), "reading_id")
    stored = stored.withColumn("timestamp", F.when(F.col("run_id") == "a-second", F.col("timestamp") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("timestamp")))
    writes = []

    def write(records, topic):
        n = len(writes)
        records.write.parquet(f"{tmp_path}/{topic}/{n}")
        writes.append(records.rdd.getNumPartitions())

    assert loop.replay_runs(stored, write, "raw", partitions=4) == ["b-first", "a-second"] and writes == [4, 4]
    for n, run in enumerate(("b-first", "a-second")):
        files = sorted((tmp_path / "raw" / str(n)).glob("part-*.parquet"))
        assert len(files) > 1
        where, steps = {}, {}
        for f in files:
            for r in __import__("pyarrow.parquet", fromlist=["x"]).read_table(f).to_pylist():
                assert dict(r["headers"][0].items())["value"] == run.encode()
                where.setdefault(r["key"], set()).add(f.name)
                steps.setdefault(r["key"], []).append(json.loads(r["value"])["timestamp"])
        assert len(where) == 8 and all(len(x) == 1 for x in where.values())
        assert all(x == sorted(x) and len(x) == 30 for x in steps.values())
    got = spark.read.parquet(f"{tmp_path}/raw/0", f"{tmp_path}/raw/1")
    assert got.count() == 480


def test_both_outputs_of_an_epoch_and_its_marker(spark, tmp_path):
    """The writer dies between both topics; the epoch comes again, and each id counts once. A repeated epoch is recognised."""
    e, pairs = pair_runs(spark)
    judged = detect.all_faults(e.where("at < 9000"), Series(("run_id", "sensor_id"), ("at", "reading_id")), "value", "at", pairs, "reading_id")
    batch = judged.select("*", *[F.lit(None).cast(k).alias(c) for c, k in judge.SOURCE.items()])
    fails = ["alerts"]

    def write(records, topic):
        if topic in fails:
            fails.remove(topic)
            raise RuntimeError("gone")
        records.write.mode("append").parquet(f"{tmp_path}/{topic}")

    def done(epoch):
        folder = tmp_path / "epochs"
        return folder.exists() and spark.read.parquet(str(folder)).where(F.col("key") == str(epoch)).count() > 0

    with pytest.raises(RuntimeError, match="gone"):
        loop.publish(batch, 7, write, done)
    assert (tmp_path / "validated").exists() and not done(7)
    assert loop.publish(batch, 7, write, done) and not loop.publish(batch, 7, write, done)
    raw = spark.read.parquet(f"{tmp_path}/validated")
    markers = spark.read.parquet(f"{tmp_path}/epochs")
    assert raw.count() == 2 * batch.count() and markers.count() == 1
    got = loop.committed(raw, markers, "reading_id")
    assert got.count() == batch.count() == got.select("reading_id").distinct().count()
    told = json.loads(markers.first().value)
    assert told == {"epoch": 7, "validated": batch.count(), "alerts": spark.read.parquet(f"{tmp_path}/alerts").count()}
    alert = json.loads(loop.committed(spark.read.parquet(f"{tmp_path}/alerts"), markers, "alert_id").where("value LIKE '%drift_correlated%'").first().value)
    assert alert["evidence"].keys() == {"observed_pearson", "expected_pearson", "deviation"} and alert["sensors"] and alert["detected_at"]
    assert loop.committed(raw, markers.where("false"), "reading_id").count() == 0


def test_stream_windows_and_dedup(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    source = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet".rsplit("/", 1)[0] + "/events*")
    w = windows.windowed(windows.once(windows.with_watermark(source, "ts", "1 hour"), "event_id"), "ts", "1 hour", None, ["event_type"], n=F.count("*"))
    q = w.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.windowed(windows.with_watermark(e, "ts", "1 hour"), "ts", "1 hour", None, ["event_type"], n=F.count("*"))
    assert spark.table("hours").exceptAll(batch).count() == 0 and spark.table("hours").count() == batch.count()


def test_versions_and_types_are_checked(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "t")
    with pytest.raises(ValueError, match="zone"):
        versioned.write(df, path, datetime(2024, 1, 1))
    versioned.write(df, path, datetime(2024, 1, 1, tzinfo=UTC))
    got = versioned.read(spark, path, df.schema)
    assert got.collect() == df.collect() and got.schema["k"].metadata["created_at"].startswith("2024-01-01")
    with pytest.raises(ValueError, match="version 1, not 2"):
        versioned.read(spark, path, df.schema, "2")
    with pytest.raises(ValueError, match="other columns"):
        versioned.read(spark, path, df.selectExpr("cast(k AS bigint) AS k", "v").schema)


def test_runs_have_a_manifest(spark, tmp_path):
    df, path = spark.createDataFrame([("x", 1, i, float(i)) for i in range(3)] + [("y", 2, 0, 0.0)], "scenario string, seed int, run int, v double"), str(tmp_path / "runs")
    for _ in range(2):
        versioned.write_runs(df, path, ["scenario", "seed", "run"])
    listed = {r.path: (r.bytes, r.sha256) for r in versioned.manifest(spark, path).collect()}
    files = list(pathlib.Path(path).rglob("*.parquet"))
    assert len(files) == 4 and listed == {str(f.relative_to(path)): (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files}


class FolderRuns:
    schema = "run string, v double"

    def __init__(self, folder):
        self.folder = folder

    def list(self):
        names = sorted(f.name for f in pathlib.Path(self.folder).iterdir())
        if not names:
            raise FileNotFoundError("no run")
        return names

    def read(self, run):
        values = [float(x) for x in (pathlib.Path(self.folder) / run).read_text().split()]
        yield pa.RecordBatch.from_pydict({"run": [run] * len(values), "v": values})


def test_a_pluggable_source_is_read_and_followed(spark, tmp_path):
    pytest.importorskip("pyspark.cloudpickle").register_pickle_by_value(__import__(__name__, fromlist=["x"]))
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "r1").write_text("1 2")
    port.register(spark, "folder_runs", FolderRuns(str(runs)))
    assert sorted(map(tuple, spark.read.format("folder_runs").load().collect())) == [("r1", 1.0), ("r1", 2.0)]

    def follow():
        q = spark.readStream.format("folder_runs").load().writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert follow() == [1.0, 2.0]
    (runs / "r2").write_text("3")
    assert follow() == [1.0, 2.0, 3.0]


def test_records_are_judged_from_end_to_end(spark, tmp_path):
    flat = spark.range(12).selectExpr(
        "concat('r', id) AS reading_id", "timestamp_seconds(180 * id) AS timestamp", "'P-1' AS plant_id", "'S1' AS sensor_id", "'flow' AS sensor_type",
        "'core' AS sensor_location", "1.0 AS elevation_m", "if(id = 5, double('NaN'), 7.0D) AS value", "'kg_s' AS unit", "if(id = 5, 'missing', 'good') AS quality", "1 AS raw_counts",
    )
    stored = readings.nested(flat).withColumn("run_id", F.lit("run"))
    replay = loop.replay(stored)
    assert [r.key for r in replay.collect()] == ["S1"] * 12
    lost = replay.limit(1).withColumn("value", F.lit(None).cast("string"))
    replay.union(lost).coalesce(1).write.parquet(str(tmp_path / "records"))
    bounds = spark.createDataFrame([("S1", 0.0, 1.0, 9.0, 10.0)], "sensor_id string, low double, alarm_low double, alarm_high double, high double")
    source = spark.readStream.schema(replay.schema).parquet(str(tmp_path / "records"))
    loop.start(source, bounds, str(tmp_path / "valid"), str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    got = {r.reading_id: r.fault_types for r in spark.read.parquet(str(tmp_path / "valid")).collect()}
    assert len(got) == 12 and got["r5"] == [] and got["r7"] == [] and got["r8"] == ["stuck"]
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == sum(map(len, got.values()))
    _, bad = loop.taken(spark.read.parquet(str(tmp_path / "records")), bounds)
    assert [r.broken for r in bad.collect()] == [["tombstone"]]


def test_settings_of_a_connection():
    with pytest.raises(ValueError, match="SERVERS"):
        kafka.Connection.of({})
    c = kafka.Connection.of({"KAFKA_SERVERS": "h:1", "KAFKA_PROTOCOL": "SSL", "KAFKA_KEYSTORE": "/k", "KAFKA_USERNAME": ""})
    assert c.options()["kafka.ssl.keystore.location"] == "/k"
    for wrong in ({"keystore": "/k"}, {"username": "u"}, {"protocol": "SSL", "keystore_password": "x"}, {"protocol": "SASL_PLAINTEXT", "username": "u", "password": "p", "truststore": "/t"}):
        with pytest.raises(ValueError):
            kafka.Connection("h:1", **wrong)
    assert "maxOffsetsPerTrigger" not in kafka.source_options(c, "t") and kafka.source_options(c, "t", 9)["maxOffsetsPerTrigger"] == "9"


def test_matrix_file_and_descriptions(spark, tmp_path):
    long = spark.createDataFrame([("b", "a", 0.5), ("a", "a", 1.0), ("a", "b", 0.5)], "x string, y string, r double")
    reports.write_matrix(long, str(tmp_path / "m"), "x", "y", "r", ["a", "b"])
    (file,) = (tmp_path / "m").glob("*.csv")
    assert file.read_text() == "name,a,b\na,1.0,0.5\nb,0.5,\n"
    got = text_matrix.described(spark.range(52).withColumnRenamed("id", "channel")).orderBy("channel").collect()
    assert [(r.sensor_type, r.unit, r.sensor_location) for r in (got[0], got[6], got[8], got[22], got[51])] == [
        ("flow", "kg_s", "primary_loop"), ("pressure", "bar", "primary_loop"), ("thermocouple", "celsius", "primary_loop"),
        ("normalized", "normalized", "containment"), ("position", "percent", "core"),
    ]


def test_telemetry_of_a_stream(spark, sf, tmp_path):
    """Counters of three micro-batches are those of the batch; latencies are within their error; the heartbeat is there."""
    import time

    e = coarse_events(spark, sf)
    times = e.select(F.percentile("at", [0.3, 0.6]).alias("q")).first()[0]
    for k, (a, b) in enumerate([(0, times[0]), (times[0], times[1]), (times[1], 1e18)]):
        e.where((F.col("at") >= a) & (F.col("at") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    told = telemetry.listening(spark)
    try:
        late = F.abs(F.xxhash64("reading_id") % 1000) / 100.0
        q = telemetry.observed(judge.judged(source), late).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 20
        while told.batches < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(told)
    got = told.snapshot()
    judged = detect.all_faults(e, Series(("sensor_id",), ("at", "reading_id")), "value", "at")
    want = detect.counters(judged, "value").first()
    assert (got["readings"], got["without_value"], got["unknown_sensor"]) == (want.readings_total, want.readings_without_value, want.readings_unknown_sensor)
    by_type = dict(map(tuple, judged.select(F.explode("faults.fault_type").alias("t")).groupBy("t").count().collect()))
    assert got["faults"] == by_type and sum(got["severities"].values()) == want.faults_total and sum(got["qualities"].values()) == want.readings_total
    assert got["batches"] == 3 == got["batch_sizes"][float("inf")] and got["errors"] == 0 and got["heartbeat"] is not None
    values = sorted(r[0] for r in e.select(late).collect())
    for q, name in ((0.5, "latency_p50"), (0.99, "latency_p99")):
        true = values[max(1, -(-len(values) * int(100 * q) // 100)) - 1]
        assert abs(got[name] - true) <= telemetry.ERROR * true + 1e-4


def test_lag_of_a_stream_that_falls_behind():
    from pyspark.sql.streaming.listener import StreamingQueryProgress

    told = telemetry.Telemetry()
    for n in range(3):
        source = {
            "description": "KafkaV2[Subscribe[raw]]", "startOffset": None, "endOffset": json.dumps({"raw": {"0": 10 * n + 10, "1": 5 * n + 5}}),
            "latestOffset": json.dumps({"raw": {"0": 100 * (n + 1), "1": 5 * n + 5}}), "numInputRows": 15, "inputRowsPerSecond": 1.0, "processedRowsPerSecond": 1.0, "metrics": {},
        }
        progress = {
            "id": "7f4e9a3c-0000-4000-8000-000000000000", "runId": "7f4e9a3c-0000-4000-8000-000000000001", "name": None, "timestamp": f"2026-01-01T00:00:0{n}.000Z", "batchId": n,
            "batchDuration": 1, "durationMs": {}, "eventTime": {}, "stateOperators": [], "sources": [source], "sink": {"description": "x", "numOutputRows": 0, "metrics": {}},
            "numInputRows": 15, "inputRowsPerSecond": 1.0, "processedRowsPerSecond": 1.0, "observedMetrics": {},
        }
        told.progressed(StreamingQueryProgress.fromJson(progress))
        assert told.lag == {"raw-0": 90 * (n + 1), "raw-1": 0} and told.heartbeat.second == n


def test_sketches_add_up_and_slide(spark):
    rows = spark.range(20_000).selectExpr("id % 2 AS k", "pow(1.0007D, id) - 1 AS x")
    whole = sketches.counts(rows, ["k"], "x", 0.01)
    parts = sketches.merged(sketches.counts(rows.where("id < 5000"), ["k"], "x", 0.01).unionByName(sketches.counts(rows.where("id >= 5000"), ["k"], "x", 0.01)), ["k"])
    qs = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    a, b = (sorted(map(tuple, sketches.quantiles(x, ["k"], qs, 0.01).collect())) for x in (whole, parts))
    assert a == b
    for k, n, *found in a:
        values = sorted(1.0007**i - 1 for i in range(k, 20_000, 2))
        for q, x in zip(qs.values(), found, strict=True):
            true = values[max(1, __import__("math").ceil(q * n)) - 1]
            assert abs(x - true) <= 0.0101 * true
    sliding = sketches.Sliding(0.01, 100)
    for i in range(50):
        sliding.add({i: 30})
    assert sum(sliding.total.values()) == 120 and sliding.quantile(0.0) == pytest.approx(2 * sketches.gamma(0.01) ** 46 / (sketches.gamma(0.01) + 1))
    one, two = telemetry.Histogram((1, 2)), telemetry.Histogram((1, 2))
    for x in (0.5, 1, 3):
        one.add(x)
    two.add(2)
    one.merge(two)
    assert one.cumulative() == {1: 2, 2: 3, float("inf"): 4} and one.sum == 6.5
    assert sketches.Sliding(0.1, 5).quantile(0.5) is None


def test_stored_runs_are_found_and_read_in_order(spark, tmp_path):
    root = str(tmp_path / "stored")
    with pytest.raises(FileNotFoundError, match="run adapt first"):
        runs.discover(spark, root, "adapt")
    (tmp_path / "stored").mkdir()
    with pytest.raises(FileNotFoundError, match="no fault_type= folder"):
        runs.discover(spark, root, "adapt")
    for n in (10, 2, 0):
        spark.createDataFrame([(n, float(n))], "step int, v double").write.parquet(f"{root}/fault_type={n}")
    (tmp_path / "stored" / "fault_type=x").mkdir()
    (tmp_path / "stored" / "fault_type=7").mkdir()
    (tmp_path / "stored" / "notes").mkdir()
    assert list(runs.discover(spark, root, "adapt")) == [0, 2, 10]
    read = runs.in_order(spark, root, "adapt", columns=["v"])
    assert [(n, [tuple(r) for r in rows.collect()]) for n, rows in read] == [(n, [(float(n), n)]) for n in (0, 2, 10)]
    (tmp_path / "stored" / "fault_type=1").mkdir()
    (tmp_path / "stored" / "fault_type=1" / "bad.parquet").write_text("no")
    turn = runs.in_order(spark, root, "adapt")
    assert next(turn)[0] == 0
    with pytest.raises(ValueError, match="fault_type=1 is not readable"):
        next(turn)
    with pytest.raises(ValueError, match="missing columns: w"):
        next(runs.in_order(spark, root, "adapt", columns=["w"]))


def test_dimension_files(spark, tmp_path):
    path = str(tmp_path / "spans.json")
    df = spans.derive(spark.createDataFrame([("s2", 1.0), ("s2", 4.0), ("s1", 1 / 3)], "sensor string, v double"), "sensor", "v")
    text = reports.write_dimension(df, path, "sensors", "sensor")
    assert text == pathlib.Path(path).read_text() == reports.write_dimension(df.repartition(3), path, "sensors", "sensor")
    table = json.loads(text)["sensors"]
    assert list(table) == ["s1", "s2"] and table["s1"]["low"] == round(table["s1"]["low"], 6)
    again = reports.read_dimension(spark, path, "sensors", "sensor", df.schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.select([F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()))
    with pytest.raises(ValueError, match="no section water"):
        reports.read_dimension(spark, path, "water", "sensor", df.schema)
    with pytest.raises(ValueError, match="other columns"):
        reports.read_dimension(spark, path, "sensors", "sensor", df.drop("low").schema)
    for rows in ([("a", 1.0), ("a", 2.0)], [(None, 1.0)], [("a", float("nan"))]):
        with pytest.raises(ValueError):
            reports.write_dimension(spark.createDataFrame(rows, "k string, v double"), path, "x", "k")
    assert pathlib.Path(path).read_text() == text


def test_placeholders_are_resolved_or_named():
    assert reports.expanded("redis://${HOST}:${PORT}/$x ${HOST}", {"HOST": "h", "PORT": "1"}) == "redis://h:1/$x h"
    with pytest.raises(ValueError, match="not set: A, B"):
        reports.expanded("${B} ${A} ${B}", {"A": ""})


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_a_quarantined_message_is_parsed_once(spark):
    messages = spark.createDataFrame([("a", None), ("b", "{}"), ("c", "no json")], "key string, value string")
    _, bad = readings.parse(messages)
    assert _parses(bad.select(F.explode("broken").alias("what")).groupBy("what").count()) == 1
    assert {r["key"] for r in bad.collect()} == {"a", "b", "c"} and bad.columns == ["key", "value", "broken"]


def test_a_valid_message_is_parsed_once(spark, sf):
    from fluxgauge.plans.queries import message_roundtrip

    assert _parses(message_roundtrip(spark, sf)) == 1

import json
import time

import pytest
from pyspark.sql import functions as F

from ebbtide import session
from ebbtide.operators.linear import LinearModel
from ebbtide.operators.validate import EmptyBatch, check_records, quarantine, valid_records
from ebbtide.plans import scoring
from ebbtide.plans.catalog import QUERIES
from ebbtide.schema import FIELD_NAMES
from ebbtide.session import fresh_path
from ebbtide.sources import files, generator, telco
from ebbtide.streaming import requests, rollups, scoring as stream


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_csv(spark, tmp_path):
    customers = telco.with_gaps(generator.generated(spark, 100).withColumn("Churn", F.lit(0)))
    table = customers.drop("Churn").withColumn("Offer", F.nullif("Offer", F.lit("")))\
        .withColumn("InternetType", F.nullif("InternetType", F.lit("")))
    files.write_csv(table, str(tmp_path / "c"))
    assert same(table, files.read_csv(spark, str(tmp_path / "c"), files.keyed_schema()))
    assert dict(files.read_csv(spark, str(tmp_path / "c")).dtypes)["MonthlyCharges"] == "double"


def test_json_array_and_lines(spark, tmp_path):
    one, two = {"key": 1, "tenure": 5}, {"key": 2, "Gender": "Male"}
    (tmp_path / "a.json").write_text(json.dumps([one, two], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(one) + "\n" + json.dumps(two))
    array = files.read_json_documents(spark, str(tmp_path / "a.json"))
    assert same(array, files.read_json(spark, str(tmp_path / "b.json")))
    assert array.count() == 2 and array.columns == ["key", *FIELD_NAMES]
    raw = files.read_json_text(spark, str(tmp_path / "b.json"))
    assert raw.columns == ["raw"] and raw.count() == 2


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_first_rows(spark, n):
    df = spark.range(0, 3000, 3).selectExpr("(id * 7919) % 3001 AS key", "id").repartition(5)
    got = files.first_rows(df, "key", n)
    want = sorted(r.key for r in df.collect())[:n]
    assert sorted(r.key for r in got.collect()) == want


@pytest.mark.parametrize("sampled", [2, 200, 10_000])
@pytest.mark.parametrize("n", [40, 300, 700, 800, 5000])
def test_first_rows_with_text_keys_and_rows_without_one(spark, monkeypatch, n, sampled):
    monkeypatch.setattr(files, "SAMPLED", sampled)
    df = spark.range(800).selectExpr(
        "if(id % 8 = 0, NULL, concat('customer ', (id * 37) % 800)) AS `Customer ID`").repartition(5)
    got = [r[0] for r in files.first_rows(df, "Customer ID", n).collect()]
    keys = [r[0] for r in df.collect()]
    want = sorted(k for k in keys if k is not None)
    assert sorted(k for k in got if k is not None) == want[:n]
    assert len(got) == min(n, 800)


def test_training_csv_is_read_whole_unless_a_cap_is_asked_for(spark, tmp_path):
    files.write_csv(generator.generated(spark, 300), str(tmp_path / "c"))
    for cap, want in ((None, 300), (120, 120)):
        got = files.load_training_csv(spark, str(tmp_path / "c"), "key", files.keyed_schema(), cap)
        assert sorted(r.key for r in got.select("key").collect()) == list(range(want))


def test_score_json(spark):
    scored = scoring.explain_linear(generator.generated(spark, 3), LinearModel(), top_k=2)
    record = json.loads(files.score_json(scored).orderBy("key").first().json)
    assert list(record) == ["prediction", "churn_probability", "retention_risk", "feature_importance"]
    assert len(record["feature_importance"]) == 2
    assert set(record["feature_importance"][0]) == {"feature", "value", "magnitude", "direction"}
    path = fresh_path(spark, "json")
    files.write_scores_json(scored, path)
    assert spark.read.json(path).count() == 3


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == named.rstrip("/")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_stream_equals_batch_and_survives_a_restart(spark):
    customers = generator.generated(spark, 200).withColumn("Churn", F.lit(0))
    records = telco.damaged_records(customers)
    source = fresh_path(spark, "source")
    records.filter("key < 120").repartition(4).write.parquet(source)
    scores, rejected, checkpoint = (fresh_path(spark, n) for n in ("scores", "rejected", "check"))

    def run():
        query = stream.finish(stream.start_scoring(
            stream.record_stream(spark, source, files_per_batch=2),
            lambda valid: scoring.records(scoring.explain_linear(valid, LinearModel())),
            scores, rejected, checkpoint))
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run() == 120
    records.filter("key >= 120").coalesce(1).write.mode("append").parquet(source)
    assert run() == 80
    checked = check_records(records)
    batch = scoring.records(scoring.explain_linear(valid_records(checked, "key"), LinearModel()))
    assert same(spark.read.parquet(scores).drop("batch"), batch)
    assert same(spark.read.parquet(rejected).drop("batch"), quarantine(checked, "key", "raw"))


def test_capped_ingest(spark):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("source", "target", "check"))
    spark.range(500).selectExpr("id AS key", "'x' AS raw").repartition(6).write.parquet(source)
    stream.finish(stream.start_ingest(stream.record_stream(spark, source, files_per_batch=2), target, checkpoint))
    assert sorted(r.key for r in stream.ingested(spark, target, "key", 90).collect()) == list(range(90))
    assert stream.ingested(spark, target, "key").count() == 500


def arriving(spark, files, rows):
    """A folder with so many files of so many rows each."""
    source = fresh_path(spark, "source")
    spark.range(files * rows).selectExpr("id AS key", "concat('x', id) AS raw").repartition(
        files).write.parquet(source)
    return source


@pytest.mark.parametrize("cap, taken", [(0, 0), (90, 90), (100, 100), (250, 250), (900, 500)])
def test_capped_ingest_stops_at_the_cap(spark, cap, taken):
    source = arriving(spark, 5, 100)
    target, checkpoint = fresh_path(spark, "target"), fresh_path(spark, "check")
    rows = stream.record_stream(spark, source, files_per_batch=1)
    ingest = stream.CappedIngest(rows, target, checkpoint, "key", cap)
    assert ingest.run() == taken
    if taken:
        got = stream.ingested(spark, target, "key")
        assert got.count() == got.select("key").distinct().count() == taken
        # No more batches than the cap needs.
        assert got.select("batch").distinct().count() <= -(-taken // 80)
    # Once full, nothing is taken any more, whatever arrives.
    spark.range(1000, 1100).selectExpr("id AS key", "'y' AS raw").write.mode("append").parquet(source)
    assert stream.CappedIngest(rows, target, checkpoint, "key", cap).run() == min(cap, 600)


def test_a_capped_batch_run_again_takes_the_same_rows(spark):
    source, target = arriving(spark, 1, 50), fresh_path(spark, "target")
    rows = stream.record_stream(spark, source)
    ingest = stream.CappedIngest(rows, target, fresh_path(spark, "check"), "key", 70)
    first = spark.range(50).selectExpr("id AS key", "'a' AS raw")
    second = spark.range(50, 100).selectExpr("id AS key", "'b' AS raw")
    for batch, batch_id in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        ingest._take(batch, batch_id)
    assert sorted(r.key for r in stream.ingested(spark, target, "key").collect()) == list(range(70))


def test_a_listener_goes_with_its_stream(spark, monkeypatch):
    removed = []
    monkeypatch.setattr(type(spark.streams), "removeListener", lambda self, x: removed.append(x))
    source, target, checkpoint = arriving(spark, 1, 10), *(fresh_path(spark, n) for n in "tc")
    stream.finish(stream.start_ingest(stream.record_stream(spark, source), target, checkpoint, 10))
    for _ in range(100):
        if removed:
            break
        time.sleep(0.1)
    monkeypatch.undo()
    assert len(removed) == 1 and removed[0].rows in (0, 10)
    spark.streams.removeListener(removed[0])


def test_ingest_progress(spark, caplog):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("source", "target", "check"))
    spark.range(5000).selectExpr("id AS key", "'x' AS raw").repartition(5).write.parquet(source)
    progress = stream.IngestProgress(5000)
    spark.streams.addListener(progress)
    try:
        with caplog.at_level("INFO", "ebbtide.streaming.scoring"):
            stream.finish(stream.start_ingest(
                stream.record_stream(spark, source, files_per_batch=1), target, checkpoint))
            for _ in range(100):
                if progress.rows == 5000:
                    break
                time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert progress.rows == 5000
    assert any("5000/5000 rows" in r.getMessage() for r in caplog.records)


def test_shape_is_observed_along_the_way(spark, tmp_path):
    frame, seen = files.observed(spark.range(70).withColumn("x", F.lit(1)))
    frame.write.parquet(str(tmp_path / "f"))
    assert seen.get == {"rows": 70, "columns": 2}


def test_request_counts(spark):
    rows = [("2024-01-01 00:00:%02d" % s, "a") for s in range(12)] + [("2024-01-01 00:01:00", "a"),
                                                                     ("2024-01-01 00:00:59", "b")]
    df = spark.createDataFrame(rows, "ts string, client string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(str(r.window_start)[14:16], r.client): (r.requests, r.over_limit)
           for r in requests.request_counts(df, requests.SCORE_LIMIT).collect()}
    assert got == {("00", "a"): (12, True), ("01", "a"): (1, False), ("00", "b"): (1, False)}


def test_log_summary(spark):
    def line(path, status, ms):
        return json.dumps({"method": "POST", "path": path, "status": status, "latency_ms": ms})

    rows = [("2024-01-01 00:00:01", line("/p", 200, 10)), ("2024-01-01 00:00:02", line("/p", 500, 30)),
            ("2024-01-01 00:00:03", line("/p", 200, 20)), ("2024-01-01 00:02:00", line("/q", 404, 5))]
    df = spark.createDataFrame(rows, "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = requests.log_summary(requests.parse_log(df)).orderBy("path").collect()
    assert [(r.path, r.requests, r.failures, r.mean_ms, r.p50_estimate_ms, r.max_ms) for r in got] == [
        ("/p", 3, 1, 20.0, 20.0, 30.0), ("/q", 1, 1, 5.0, 5.0, 5.0)]


def test_log_means_are_exact_and_junk_is_no_request(spark):
    lines = ['{"path":"/p","latency_ms":0.004}', '{"path":"/p","latency_ms":0.004}',
             '{"path":"/p","latency_ms":null}', '{"path":"/q"}', '{"path":', "[1]", "", None,
             '{"status":200}']
    df = spark.createDataFrame([("2024-01-01 00:00:01", x) for x in lines], "ts string, line string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.path: r for r in requests.log_summary(requests.parse_log(df)).collect()}
    assert got["/p"].mean_ms == 0.004 and got["/p"].requests == 3
    assert got["/q"].mean_ms is None and got["/q"].p50_estimate_ms is None and set(got) == {"/p", "/q"}
    assert [r.line for r in requests.unreadable_log(df).collect()] == lines[4:]


def test_late_rows_and_open_windows_are_told(spark, tmp_path):
    def rows(*times):
        df = spark.createDataFrame([(t, "a") for t in times], "ts string, client string")
        return df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)

    source = str(tmp_path / "in")
    query = None
    # The second run closes what the first one saw; the third row of all is then too late.
    for batch in (rows("2024-01-01 00:00:10", "2024-01-01 02:00:00"),
                  rows("2024-01-01 00:00:20", "2024-01-01 03:00:00")):
        batch.write.mode("append").parquet(source)
        arriving = spark.readStream.schema("ts timestamp, client string").parquet(source)
        counted = requests.request_counts(requests.with_lateness(arriving))
        query = stream.finish(requests.start_table(counted, str(tmp_path / "out"), str(tmp_path / "c")))
    assert requests.late_rows(query) == 1
    left = requests.still_open(spark.read.parquet(source)).first()
    assert (left.rows, left.windows) == (1, 1)


def test_event_streams_read_tables_in_several_files(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("rate_breach_stream", "log_summary_stream"):
        one = sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=repr)
        assert one and one == sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr)


def test_a_file_is_scored_and_its_bad_lines_kept(spark, tmp_path):
    source = tmp_path / "in.csv"
    names = ["key", *FIELD_NAMES]
    good = {n: "1" for n in names} | {"Contract": "Two Year", "Gender": "Male", "Offer": "",
                                      "InternetType": "DSL", "PaymentMethod": "Credit Card"}
    lines = [good | {"key": "1"}, good | {"key": "2", "TotalCharges": "junk"},
             good | {"key": "3", "Age": " "}]
    text = [",".join(names), *[",".join(r[n] for n in names) for r in lines], "4,Male"]
    source.write_text("\n".join(text) + "\n")
    seen = scoring.score_file(spark, str(source), str(tmp_path / "s"), str(tmp_path / "r"))
    assert seen["rows"] == 4
    assert [r.key for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [1]
    bad = {r.key: r.errors for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert bad == {2: ["TotalCharges:not a number"], 3: ["Age:not a number"], 4: ["record:malformed"]}
    source.write_text(",".join(names) + "\n")
    with pytest.raises(EmptyBatch):
        scoring.score_file(spark, str(source), str(tmp_path / "s2"), str(tmp_path / "r2"))


def test_the_run_folder_is_shared_and_its_own(spark):
    path = fresh_path(spark, "x")
    assert path.startswith(session.run_folder(spark) + "/x-")
    spark.range(3).write.parquet(path)
    session.remove(spark, path)
    assert not spark.sparkContext._jvm.java.io.File(path).exists()


def test_sketches_merge_to_longer_windows(spark):
    lines = spark.range(60_000).select(
        F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") % 20_000).alias("ts"),
        F.when(F.col("id") % 3 == 0, "/hot").otherwise("/p").alias("path"),
        F.lit(200).alias("status"), F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("double")
        .alias("latency_ms"))
    minutes = rollups.minutes(lines)
    hours, day = rollups.rolled(minutes, "1 hour"), rollups.rolled(minutes, "1 day")
    for table in (day, rollups.rolled(hours, "1 day")):
        errors = rollups.rank_errors(table, lines, "1 day", (0.01, 0.5, 0.95, 0.999)).collect()
        assert len(errors) == 8 and max(r.error for r in errors) <= rollups.RANK_ERROR
    exact = {r.path: r for r in lines.groupBy("path").agg(
        F.count("*").alias("n"), F.max("latency_ms").alias("top"), F.avg("latency_ms").alias("mean")).collect()}
    for r in rollups.summary(rollups.rolled(hours, "1 day")).collect():
        e = exact[r.path]
        assert (r.requests, r.max_ms, r.failures) == (e.n, e.top, 0)
        assert r.mean_ms == pytest.approx(e.mean)


def test_sketches_without_latencies(spark):
    rows = [("2024-01-01 00:00:01", "/p", 500, None), ("2024-01-01 00:00:02", "/p", 200, float("nan")),
            ("2024-01-01 00:00:03", "/q", 200, 4.0), ("2024-01-01 00:00:04", "/q", 200, float("nan"))]
    df = spark.createDataFrame(rows, "ts string, path string, status int, latency_ms double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.path: r[2:] for r in rollups.summary(rollups.rolled(rollups.minutes(df), "1 hour")).collect()}
    assert got == {"/p": (2, 1, None, None, None, None), "/q": (2, 0, 4.0, 4.0, 4.0, 4.0)}
    assert rollups.summary(rollups.rolled(rollups.minutes(df.where("false")), "1 day")).count() == 0

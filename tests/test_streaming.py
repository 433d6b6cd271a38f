from datetime import datetime, timedelta

from pyspark.sql import functions as F

from castwise.streaming import jobs

EXPERTS = ["a", "b"]
SCHEMA = "sample_key string, model_name string, mae double, at timestamp"
T0 = datetime(2024, 1, 1)


def write(spark, path, rows, minute=0):
    at = T0 + timedelta(minutes=minute)
    spark.createDataFrame([(*r, at) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.read_stream(spark, path, schema, 1)


def test_labels_come_when_complete_and_late_rows_are_told(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")

    def run():
        assert jobs.stream_labels(stream(spark, src), EXPERTS, "mae", dst, dst + "-c").awaitTermination(90)
        return sorted((r.sample_key, r.status, r.oracle_model, r.oracle_value) for r in spark.read.parquet(dst).collect())

    write(spark, src, [("s1", "a", 2.0), ("s2", "a", 1.0)])
    write(spark, src, [("s1", "b", 2.0)])
    assert run() == [("s1", "label", "a", 2.0)]
    # restart with the same checkpoint: s2 completes, a second value for s1 is late
    write(spark, src, [("s2", "b", 0.5), ("s1", "b", 0.1)])
    assert run() == [("s1", "label", "a", 2.0), ("s1", "late", "a", 2.0), ("s2", "label", "b", 0.5)]


def states(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def test_labels_with_timers(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")

    def run():
        rows = stream(spark, src).withWatermark("at", "1 minute")
        with jobs.with_rocksdb(spark):
            q = jobs.to_table(jobs.timed_labels(rows, EXPERTS, "mae", "at", 3_600_000, shards=3), dst, dst + "-c")
        assert q.awaitTermination(180)
        return q, sorted((r.sample_key, r.status, r.oracle_model, r.oracle_value, r.a, r.b) for r in spark.read.parquet(dst).collect())

    write(spark, src, [("s1", "a", 2.0), ("s2", "a", 1.0), ("s4", "a", 5.0), ("s4", "a", 4.0), ("s4", "b", 4.0), ("s4", "c", 0.0), ("s4", "b", None)])
    write(spark, src, [("s1", "b", 1.0)], 1)
    write(spark, src, [("s1", "b", 0.0), ("s1", "a", 9.0)], 2)
    _, got = run()
    first = [("s1", "label", "b", 1.0, 2.0, 1.0), ("s4", "label", "a", 4.0, 4.0, 4.0)]
    late = [("s1", "late", "b", 1.0, 2.0, 1.0)] * 2
    assert got == sorted(first + late)
    # a restart goes on with the stored state; time passes and every sample of before leaves it
    write(spark, src, [("s3", "a", 1.0)], 600)
    write(spark, src, [("s3", "b", 3.0)], 601)
    q, got = run()
    timeout = [("s2", "timeout", None, None, 1.0, None)]
    assert got == sorted(first + late + timeout + [("s3", "label", "a", 1.0, 1.0, 3.0)], key=lambda r: r[:2])
    assert states(q) > 0
    write(spark, src, [("s5", "x", 1.0)], 2000)  # an unknown expert moves the clock only
    write(spark, src, [("s5", "x", 1.0)], 2001)
    q, again = run()
    assert again == got
    assert states(q) == 0


def test_rows_behind_the_watermark_go_aside(spark, tmp_path):
    src, dst, late = (str(tmp_path / n) for n in ("src", "dst", "late"))

    def run():
        assert jobs.split_late(stream(spark, src), "at", "10 minutes", dst, late, dst + "-c").awaitTermination(120)
        return [sorted((r.sample_key, r.at) for r in spark.read.schema(SCHEMA).parquet(p).collect()) for p in (dst, late)]

    def at(minute):
        return T0 + timedelta(minutes=minute)

    write(spark, src, [("s1", "a", 1.0)], 0)
    write(spark, src, [("s2", "a", 1.0)], 30)
    write(spark, src, [("s3", "a", 1.0)], 20)  # just on the watermark
    assert run() == [[("s1", at(0)), ("s2", at(30)), ("s3", at(20))], []]
    write(spark, src, [("s4", "a", 1.0)], 19)  # behind it, also over a restart
    spark.createDataFrame([("s5", "a", 1.0, None)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    write(spark, src, [("s6", "a", 1.0)], 25)
    assert run() == [[("s1", at(0)), ("s2", at(30)), ("s3", at(20)), ("s6", at(25))], [("s4", at(19)), ("s5", None)]]


def test_ingest_forgets_keys_behind_the_watermark(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    schema = spark.createDataFrame([], SCHEMA).schema
    write(spark, src, [(f"s{i}", "a", 1.0) for i in range(50)], 0)
    write(spark, src, [(f"s{i}", "a", 2.0) for i in range(50)], 5)  # repeats within the delay
    write(spark, src, [("t", "a", 1.0)], 600)
    write(spark, src, [("t", "a", 1.0)], 601)
    q = jobs.stream_ingest(spark, src, dst, dst + "-c", schema, 1, "at", "10 minutes")
    assert q.awaitTermination(120)
    got = spark.read.parquet(dst)
    assert got.count() == 51 and got.filter("mae = 2").count() == 0
    assert states(q) == 1


def test_ingest_keeps_each_pair_once_over_restarts(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in ([("s1", "a", 1.0), ("s1", "a", 1.0)], [("s1", "a", 1.0), ("s1", "b", 2.0)]):
        write(spark, src, rows)
        assert jobs.stream_ingest(spark, src, dst, dst + "-c", schema).awaitTermination(90)
    got = spark.read.parquet(dst).groupBy("model_name").agg(F.count("*").alias("n")).collect()
    assert {r.model_name: r.n for r in got} == {"a": 1, "b": 1}

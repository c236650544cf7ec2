import time

from pyspark.sql import functions as F

from siltstone.streaming import events as ev

SF = "/root/testdata/sf0.001"


def staged(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    rows.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_windows_match_the_batch(spark, tmp_path):
    rows, path = staged(spark, tmp_path)
    run(ev.windowed(ev.source(spark, path, rows.schema, 10), "1 hour"), "tumbling", "complete", tmp_path)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(spark.table("tumbling")) == key(ev.windowed(ev.timed(rows), "1 hour"))


def test_first_seen(spark, tmp_path):
    rows, path = staged(spark, tmp_path)
    run(ev.first_seen(ev.source(spark, path, rows.schema).select("user_id", "event_type"), ["user_id", "event_type"]), "seen", "append", tmp_path)
    assert spark.table("seen").count() == rows.select("user_id", "event_type").distinct().count()


def test_retry_and_fan_out(spark, tmp_path):
    rows, path = staged(spark, tmp_path)
    got, tries = [], []

    def write(df):
        tries.append(time.time())
        if len(tries) == 1:
            raise OSError("away")
        got.append(df.count())

    sink, other = ev.RetryingSink(write), []
    q = (
        ev.envelopes(ev.without_ignored(ev.source(spark, path, rows.schema, 10))).writeStream
        .foreachBatch(lambda df, i: ev.fan_out(df, i, [sink, lambda b, _: other.append(b.agg(F.count("id")).first()[0])]))
        .option("checkpointLocation", str(tmp_path / "retry")).start()
    )
    q.processAllAvailable()
    q.stop()
    assert sink.counts["failure"] == 1 and sum(got) == sum(other) == rows.where("event_type <> 'error'").count()


def test_breaker_waits_after_failures():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    left = [4]

    def write(_):
        if left[0]:
            left[0] -= 1
            raise OSError("away")

    sink = ev.RetryingSink(write, threshold=2, backoff=10, most=9, clock=lambda: now[0], sleep=sleep)
    sink(None, 0)
    assert slept == [10, 10, 10] and sink.counts == {"success": 1, "failure": 4, "pending": 0} and sink.errors == {"OSError": 4}
    assert not sink.open() and sink.recent == 0


def test_running_pulls(spark, tmp_path):
    rows, path = staged(spark, tmp_path)
    run(ev.running_pulls(ev.source(spark, path, rows.schema)), "pulls", "complete", tmp_path)
    assert sorted(map(tuple, spark.table("pulls").collect())) == sorted(map(tuple, ev.running_pulls(rows).collect()))


def test_envelopes_are_posted(spark, tmp_path):
    rows, _ = staged(spark, tmp_path)
    at = str(tmp_path / "posted")
    ev.post_envelopes(ev.envelopes(rows), at)
    got = spark.read.json(at).select(F.explode("events").alias("e")).select("e.*")
    assert got.count() == rows.count() and got.select("id").distinct().count() == rows.count()

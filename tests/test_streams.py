from conftest import rows
from pyspark.sql import functions as F

from catalog_audit.streaming import usage as su
from catalog_audit.streaming.keyed import KeyedTable

SCHEMA = "event_id bigint, item_luid string, event_name string, event_ts timestamp"


def write(frame, folder, i, data):
    df = frame("event_id bigint, item_luid string, event_name string, ts string", data)
    df.select("event_id", "item_luid", "event_name", F.to_timestamp("ts").alias("event_ts")).coalesce(1).write.parquet(f"{folder}/part{i}")


def test_late_events_and_repeats(spark, frame, tmp_path):
    folder = str(tmp_path / "events")
    write(frame, folder, 1, [(1, "v1", "view", "2025-01-10 10:00:00"), (1, "v1", "view", "2025-01-10 10:00:00"), (2, "v1", "edit", "2025-01-10 11:00:00"),
                             (3, "v2", "view", "2025-01-11 09:00:00"), (9, "ghost", "view", "2025-01-11 09:00:00"), (None, "v2", "view", "2025-01-11 09:00:00"),
                             (8, "v1", "view", None)])
    luids = frame("luid string, workbook_id string", [("v1", "A"), ("v2", "A")])

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
        return su.UsageStream(stream, luids, str(tmp_path / "state"), delay="2 days", days=3).run()

    def daily(s):
        return rows(s.daily.read().where("day IS NOT NULL").withColumn("day", F.date_format("day", "yyyy-MM-dd")), "day", "workbook_id", "views")

    assert daily(run()) == [("2025-01-10", "A", 1), ("2025-01-11", "A", 2)]
    write(frame, folder, 2, [(5, "v1", "view", "2025-01-20 01:00:00"), (1, "v1", "view", "2025-01-10 10:00:00")])
    run()
    # ten days late, and still counted; repeats of what has left the state are not
    write(frame, folder, 3, [(6, "v1", "view", "2025-01-10 23:30:00"), (6, "v1", "view", "2025-01-10 23:30:00"), (1, "v1", "view", "2025-01-10 10:00:00"),
                             (7, "v2", "view", "2025-01-20 02:00:00"), (5, "v1", "view", "2025-01-20 01:00:00"), (8, "v1", "view", None)])
    s = run()
    assert daily(s) == [("2025-01-10", "A", 2), ("2025-01-11", "A", 2), ("2025-01-20", "A", 2)]
    assert rows(s.daily.read().where("day IS NULL"), "views") == [(1,)]
    assert rows(s.windows.read()) == rows(su.trailing_views(s.daily.read(), 3))
    # a replayed batch changes nothing
    last = s.daily.state()["batch"]
    before = rows(s.daily.read())
    arrived = frame("event_id bigint, workbook_id string, ts string, kept boolean", [(77, "A", "2025-01-21 00:00:00", k) for k in (True, False)])
    s.apply(arrived.select("event_id", "workbook_id", F.to_timestamp("ts").alias("event_ts"), "kept"), last)
    assert rows(s.daily.read()) == before and rows(s.windows.read()) == rows(su.trailing_views(s.daily.read(), 3))
    s.daily.vacuum(1)
    assert rows(s.daily.read()) == before
    assert rows(run().daily.read()) == before


def test_batches_do_not_change_the_total(spark, frame, tmp_path):
    folder = str(tmp_path / "events")
    data = [(k % 150, f"v{k % 3}", "view", f"2025-02-{k % 150 * 7 % 27 + 1:02d} 10:00:00") for k in range(0, 400, 2)]
    df = frame("event_id bigint, item_luid string, event_name string, ts string", data)
    df.select("event_id", "item_luid", "event_name", F.to_timestamp("ts").alias("event_ts")).repartition(6).write.parquet(folder)
    luids = frame("luid string, workbook_id string", [("v0", "A"), ("v1", "B"), ("v2", "C")])
    got = []
    for n in (1, 6):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", n).parquet(folder)
        s = su.UsageStream(stream, luids, str(tmp_path / f"state{n}"), delay="1 day", days=4, buckets=3).run()
        got.append((rows(s.daily.read()), rows(s.windows.read())))
    assert got[0] == got[1] and sum(r[2] for r in got[0][0]) == len(set(data))


def test_keyed_table(spark, frame, tmp_path):
    schema = "k string, seq bigint, v string"
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], lambda df: df.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v")), buckets=4)
    assert table.read().count() == 0
    assert table.merge(frame(schema, [("a", 1, "x"), ("b", 1, "y"), (None, 1, "n")]), 0)
    first = table.state()["buckets"]
    assert table.merge(frame(schema, [("a", 2, "z")]), 1)
    second = table.state()["buckets"]
    assert sum(second[b] != first.get(b) for b in second) == 1  # only the bucket of "a" is written anew
    assert not table.merge(frame(schema, [("a", 9, "no")]), 1)
    assert table.merge(frame(schema, []), 2)
    want = [("a", 2, "z"), ("b", 1, "y"), (None, 1, "n")]
    assert rows(table.read()) == sorted(want, key=repr)
    # a batch that failed before its commit left folders behind; its retry wins
    frame(schema, [("q", 5, "lost")]).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(str(tmp_path / "t/data/000000000003"))
    assert rows(table.read()) == sorted(want, key=repr)
    assert table.merge(frame(schema, [("b", 3, "w")]), 3) and table.vacuum(1) > 0
    assert rows(table.read()) == sorted([("a", 2, "z"), ("b", 3, "w"), (None, 1, "n")], key=repr)


def test_trailing_windows(frame):
    daily = frame("day string, workbook_id string, views bigint", [("2025-01-01", "A", 2), ("2025-01-03", "A", 5)])
    got = dict((r.window_start.isoformat(), r.views) for r in su.trailing_views(daily, 3).collect())
    assert got == {"2024-12-30": 2, "2024-12-31": 2, "2025-01-01": 7, "2025-01-02": 5, "2025-01-03": 5}


def test_tables_may_be_files_or_folders(spark, frame, tmp_path):
    from catalog_audit.streaming.sinks import file_stream
    jobs = frame("datasource_id string, completed_at string, status string", [("a", "2025-01-01", "Success"), ("a", "2025-01-02", "Failed")])
    jobs.repartition(2).write.parquet(str(tmp_path / "jobs.parquet"))  # a folder of part files
    stream = file_stream(spark, str(tmp_path), "jobs", max_files=1)
    assert rows(su.stream_latest_refresh(stream), "datasource_id", "failed") == [("a", True)]


def test_the_identifier_map_is_joined_by_its_stored_size(spark, frame, tmp_path):
    folder = str(tmp_path / "events")
    write(frame, folder, 1, [(1, "v1", "view", "2025-01-10 10:00:00")])
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    # the optimizer takes a map that was exploded for no larger than its sources
    luids = spark.range(1000).select(F.explode(F.array(F.concat(F.lit("v"), "id"), F.concat(F.lit("w"), "id"))).alias("luid"), F.lit("A").alias("workbook_id"))
    plan = su.UsageStream(stream, luids, str(tmp_path / "state")).rows._jdf.queryExecution().analyzed().toString()
    assert "Generate" not in plan and "Range" not in plan

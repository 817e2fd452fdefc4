"""Streaming jobs over file sources, run to the end of what is there."""

from pyspark.sql import functions as F

from fieldtally.sources.growing import GrowingReader, stream_lines
from fieldtally.streaming import jobs

STOCK = "id long, product string, facility string, other_facility string, event_type string, entry_type string, status string, quantity string"


def test_running_stock_balance(spark, tmp_path):
    rows = [(1, "p", "A", "B", "DISPATCHED", "ISSUED", "ACCEPTED", "5"), (2, "p", "A", "B", "RECEIVED", "RECEIPT", "ACCEPTED", "9"), (3, "p", "B", "A", "DISPATCHED", "RETURNED", "ACCEPTED", "x")]
    spark.createDataFrame(rows, STOCK).write.json(str(tmp_path / "in"))
    seen = {}

    def sink(df, _):
        seen.update({r["facility"]: r["on_hand"] for r in df.collect()})

    stream = spark.readStream.schema(STOCK).json(str(tmp_path / "in"))
    q = jobs.stock_balance(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert seen == {"A": 4.0, "B": 5.0}


def test_progress_counts_a_person_once_a_day(spark, tmp_path):
    rows = [("w", "b1", "2024-01-01 08:00:00"), ("w", "b1", "2024-01-01 09:00:00"), ("w", "b2", "2024-01-01 10:00:00"), ("w", "b1", "2024-01-02 08:00:00")]
    tasks = spark.createDataFrame(rows, "worker string, beneficiary_id string, t string").select("worker", "beneficiary_id", F.col("t").cast("timestamp").alias("served_at"))
    want = {("2024-01-01", 2), ("2024-01-02", 1)}
    assert {(str(r["day"]), r["done"]) for r in jobs.progress_by_day(tasks).collect()} == want
    tasks.write.parquet(str(tmp_path / "in"))
    seen = {}

    def sink(df, _):
        seen.update({str(r["day"]): r["done"] for r in df.collect()})

    stream = spark.readStream.schema(tasks.schema).parquet(str(tmp_path / "in"))
    q = jobs.progress_by_day(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert set(seen.items()) == want


def test_rows_on_time_and_late(spark, tmp_path):
    """Both tables together are all rows; the watermark moves with earlier batches only."""
    schema, src = "id long, t timestamp", tmp_path / "in"
    src.mkdir()
    days = [[(1, "2024-01-10"), (2, "2024-01-01"), (3, None)], [(4, "2024-01-07"), (5, "2024-01-08"), (6, "2024-02-01")], [(7, "2024-01-31"), (8, "2024-01-09")]]
    for part in days:
        rows = [f'{{"id": {i}' + (f', "t": "{t}T00:00:00"' if t else "") + "}" for i, t in part]
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(str(src))
        q = jobs.stream_on_time(spark.readStream.schema(schema).json(str(src)), "t", str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    ids = lambda late: sorted(r["id"] for r in jobs.rows_on_time(spark, str(tmp_path / "out"), late).collect())
    assert ids(True) == [3, 4, 8] and ids(False) == [1, 2, 5, 6, 7]


def test_lines_of_growing_files(spark, tmp_path):
    """Lines appended between batches and over a restart come once; half a line waits; a
    file is read by several tasks."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("".join(f"line {i} é\n" for i in range(500)) + "hal")
    (src / ".hidden.log").write_text("no\n")
    (src / "other.txt").write_text("no\n")
    seen = []

    def sink(df, _):
        seen.extend((r["file"], r["value"]) for r in df.collect())

    def go():
        q = stream_lines(spark, str(src), ".log", 700).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            yield q.processAllAvailable
        finally:
            q.stop()

    for run in go():
        run()
        assert sorted(seen) == sorted(("a.log", f"line {i} é") for i in range(500))
        with (src / "a.log").open("a") as f:
            f.write("f\nx")
        (src / "b.log").write_text("\n" + "y" * 5000 + "\r\n")
        run()
    with (src / "a.log").open("a") as f:
        f.write("\n")
    for run in go():
        run()
    assert seen[500:] and sorted(seen[500:]) == [("a.log", "half"), ("a.log", "x"), ("b.log", ""), ("b.log", "y" * 5000)]
    reader = GrowingReader(str(src), ".log", 700)
    pieces = reader.partitions({"a.log": 10**9}, reader.latestOffset())
    assert len(pieces) > 5 and pieces[0].start == 0  # a shorter file was written anew


def test_gap_of_touched_areas(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a", 3), ("a", 2)], "boundary_code string, people int").write.json(str(tmp_path / "in"))
    estimates = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "boundary_code string, expected double")
    stream = spark.readStream.schema("boundary_code string, people int").json(str(tmp_path / "in"))
    q = jobs.stream_gap(stream, estimates, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(r["boundary_code"], r["gap"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 5.0)]


PEOPLE = "id string, given_name string, family_name string, father_name string, date_of_birth string, mobile_number string, gender string, latitude double, longitude double"


def test_duplicates_at_registration(spark, tmp_path):
    person = ("Amina", "Deby", "Saleh", "1990-04-02", "66123456", "F", 12.0, 15.0)
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(PEOPLE).json(str(src))
    q = jobs.stream_dedup(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for i, name in enumerate(["p1", "p2"]):
        spark.createDataFrame([(name, *person), (f"x{i}", "Zenaba", "Kodi", "Issa", f"197{i}-01-01", f"6600000{i}", "F", 13.0, 16.0)], PEOPLE).coalesce(1).write.mode("append").json(str(src))
        q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).where("id1 LIKE 'p%'").collect()
    assert [(r["id1"], r["id2"]) for r in got] == [("p1", "p2")] and got[0]["score"] > 0.95
    assert spark.read.parquet(str(tmp_path / "index")).select("id").distinct().count() == 4

"""Keyed state: sums over restarts, order within a batch, forgetting; and parts that all tasks share."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from taxrecon.streaming import jobs

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(rows):
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(hours=h), u, "error", v, "") for i, h, u, v in rows]


def crossings(rows, limit):
    """The definition, event by event."""
    running, out = {}, []
    for i, ts, u, kind, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind != "error":
            continue
        was = running.get(u, 0)
        running[u] = was + (round(v * 100) if v is not None else 0)
        if running[u] > limit >= was:
            out.append((u, i, running[u]))
    return sorted(out)


def run(spark, path, batches, limit, idle=None, name="out"):
    """Each batch arrives, is worked off, and the stream starts anew from its checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(2).write.parquet(f"{path}/in/{name}-{k}")
        stream = jobs.event_stream(spark, f"{path}/in", "*")
        stream = stream.withWatermark("ts", "1 hour") if idle else stream
        with jobs.stateful(spark):
            jobs.finished(jobs.threshold_alerts(stream, limit, idle).writeStream.format("parquet").option("path", f"{path}/{name}").outputMode("append"), f"{path}/cp-{name}")
    return sorted(tuple(r) for r in spark.read.schema("user_id bigint, event_id bigint, running bigint").parquet(f"{path}/{name}").collect())


def test_sums_go_on_over_restarts(spark, tmp_path):
    r = random.Random(4)
    rows = events((i, i // 3, r.randrange(3), r.choice([5.0, 20.0, -15.0, None])) for i in range(90))
    rows += [(1000 + i, rows[i][1], 1, "purchase", 500.0, "") for i in range(5)]
    rows.sort(key=lambda x: x[1])
    want = crossings(rows, 4_000)
    assert len(want) > 3 and run(spark, tmp_path, [rows[:40], rows[40:41], rows[41:]], 4_000) == want


def test_a_silent_vendor_is_forgotten(spark, tmp_path):
    first = events([(1, 0, 7, 90.0), (2, 1, 8, 90.0)])
    later = events([(3, 24 * 20, 8, 1.0)])  # the watermark passes vendor 7's time
    again = events([(4, 24 * 21, 7, 90.0), (5, 24 * 21, 8, 98.0), (6, 24 * 22, 7, 20.0), (7, 24 * 22, 8, 2.0), (8, 24 * 40, 8, 200.0)])
    want = [(7, 6, 11_000), (8, 7, 10_100), (8, 8, 20_000)]
    assert run(spark, tmp_path, [first, later, events([(9, 24 * 20 + 1, 9, 1.0)]), again], 10_000, "10 days") == want
    assert run(spark, tmp_path / "one", [first + later + again], 10_000, "10 days") == want  # in one batch as well


def test_parts_have_as_many_files_and_lose_nothing(spark, sf_dir, tmp_path):
    import pathlib

    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/events.parquet")
    folder, files = jobs.split_by_time(spark, table, f"{tmp_path}/in")
    found = [len(list(p.glob("part-*.parquet"))) for p in sorted(pathlib.Path(folder).iterdir())]
    assert files > 1 and found == [files] * 5
    assert spark.read.parquet(f"{folder}/*").count() == table.count()
    none, one = jobs.split_by_time(spark, table.limit(0), f"{tmp_path}/none")
    assert one == 1 and spark.read.parquet(f"{none}/*").count() == 0

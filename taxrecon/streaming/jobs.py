"""Streaming intake, live figures and stream reconciliation.

Events map to the domain: user_id is a vendor, value tax in rupees, purchase a line of the buyer's book,
signup a line of the suppliers', error a mismatch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions import scoring
from ..operators import explain
from ..sources import returns, sinks
from ..sources.storage import shared_dir

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
#: Later than any event: closes the last windows. Rows of it are filtered out again.
END = "9000-01-01 00:00:00"


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", end: str | None = None, files: int | None = None) -> DataFrame:
    """Events of a folder's files, and those of the closing folder end; a table may be a file or a folder of part
    files, and a batch takes so many of them. Timestamps without a zone are UTC."""
    schema = EVENTS.replace("ts timestamp", "ts timestamp_ntz")

    def read(path: str, names: str) -> DataFrame:
        reader = spark.readStream.schema(schema).option("pathGlobFilter", names).option("recursiveFileLookup", True)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)

    # The filter sees names of files alone, so a folder of part files is read as such.
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    found = [] if glob == "*" else name.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(name) or []
    parts = [read(x.getPath().toString(), "*") for x in found if x.isDirectory()]
    if not parts or any(x.isFile() for x in found):
        parts.append(read(folder, "*.parquet" if glob == "*" else glob))
    if end:
        parts.append(read(end, "*.parquet"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("tax", F.round(F.col("value") * 100).cast("bigint"))


def split_by_time(spark: SparkSession, events: DataFrame, path: str, parts: int = 5, close: bool = False) -> tuple[str, int]:
    """Writes events as parts by ranges of time, one after the other, so that a stream takes them in that order; with
    close, the closing events after them. Returns the folder and the files of a part, as many for each: a batch of so
    many files is a part, and all tasks of a cluster write and read it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    if low is None:
        events.limit(0).write.parquet(f"{path}/part-0")
    step = (high - low) // parts + 1 if low is not None else 1
    part = ((at - F.lit(low)) / F.lit(step)).cast("int") if low is not None else F.lit(0)
    sizes = {r["p"]: r["n"] for r in events.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a part
    # With so many rows a file, none is left empty.
    files = max(1, min([2 * spark.sparkContext.defaultParallelism, *(n // 500 for n in sizes.values())])) if sizes else 1
    for i in range(parts if low is not None else 0):
        if i in sizes:
            events.filter((at >= low + i * step) & (at < low + (i + 1) * step)).repartition(files).write.parquet(f"{path}/part-{i}")
    if close:
        closing(spark, f"{path}/part-end")
    return path, files


def latest(path: str):
    """For foreachBatch in update mode: keeps each batch's rows under its number. A batch that comes again replaces its
    own."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def closing(spark: SparkSession, path: str) -> str:
    """Writes one far-future event of each kind that the joins need."""
    rows = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(END).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.explode(F.array(F.lit("purchase"), F.lit("signup"))).alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    rows.write.parquet(path)
    return path


def finished(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream over what there is and waits."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An event that is sent again within the delay counts once."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events (with a watermark on ts) and their tax per window and type; tumbling, or sliding with slide."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("tax").alias("tax")).select(F.col("w.start").alias("start"), "event_type", "n", "tax")


def reconciled(events: DataFrame, other: DataFrame, days: int = 1, delay: str = "1 hour") -> DataFrame:
    """Lines of the buyer's book left-joined to the suppliers' lines of the same vendor within days."""
    p = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"), F.col("ts").alias("pts")).withWatermark("pts", delay)
    q = other.filter("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("user_id").alias("qu"), F.col("ts").alias("qts")).withWatermark("qts", delay)
    within = F.expr(f"pu = qu and qts >= pts and qts <= pts + interval {days} days")
    return p.join(q, within, "leftOuter").select("purchase_id", F.col("pu").alias("user_id"), "signup_id", F.when(F.col("signup_id").isNull(), "Missing in GSTR-1").otherwise(scoring.MATCHED).alias("status"))


def intake(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """Invoice rows as they are posted (all text): coerced, checked, enriched. vendors is a static table."""
    good, _ = returns.checked_invoices(rows)
    v = vendors.select("vendor_id", F.col("name").alias("n"), F.col("gstin").alias("g"))
    out = good.join(v, F.col("vendorId") == F.col("vendor_id"), "left")
    tax = F.col("cgst") + F.col("sgst") + F.col("igst")
    status = scoring.presence_status(F.col("gstr1Reported"), F.col("gstr2bReported"))
    out = out.withColumn("total_tax", tax).withColumn("match_status", status)
    return out.select(F.col("id").alias("invoice_id"), F.col("vendorId").alias("vendor_id"), F.coalesce("n", F.lit("Unknown")).alias("vendor_name"), F.coalesce("g", F.lit("")).alias("gstin"), F.col("date").alias("invoice_date"), "period", "taxable", "total_tax", (F.col("taxable") + F.col("total_tax")).alias("total"), "match_status", scoring.invoice_risk_level(F.col("match_status"), F.col("total_tax")).alias("risk_level"))


def reconcile_changes(path: str, keys: list[str], stamp: str, run):
    """For foreachBatch: upserts the batch's periods at path, then calls run(spark, periods) for these alone.
    A batch that comes again changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = sinks.last_write_wins(batch, keys, [F.desc(stamp)])
        try:
            old = spark.read.parquet(path).select(*batch.columns)
            held = old.join(new.select("period").distinct(), "period", "left_semi").checkpoint()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = batch.limit(0)
        sinks.upsert(path, held, new, keys, stamp)
        run(spark, new.select("period").distinct())

    return apply


def threshold_crossings(events: DataFrame, limit: int, sums: DataFrame | None = None) -> DataFrame:
    """Batch form of the alert: the mismatch events at which a vendor's running tax exceeds limit and didn't before. sums
    (user_id, sum): what vendors had before these events. Days are summed first; only the events of days on which a
    vendor's sum can pass the limit are put in order, so no task has all events of a vendor."""
    tax = F.round(F.col("value") * 100).cast("bigint")
    bad = events.filter("event_type = 'error'").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), F.coalesce(tax, F.lit(0)).alias("tax"))
    up, down = F.sum(F.greatest("tax", F.lit(0))).alias("up"), F.sum(F.least("tax", F.lit(0))).alias("down")
    daily = bad.groupBy("user_id", "day").agg(F.sum("tax").alias("sum"), up, down)
    start = F.coalesce(F.sum("sum").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = daily.withColumn("start", start)
    if sums is not None:
        before = sums.select("user_id", F.col("sum").alias("had"))
        held = held.join(before, "user_id", "left").withColumn("start", F.col("start") + F.coalesce("had", F.lit(0)))
    days = held.filter((F.col("start") + F.col("up") > limit) & (F.col("start") + F.col("down") <= limit)).select("user_id", "day", "start")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = bad.join(days, ["user_id", "day"]).withColumn("running", F.col("start") + F.sum("tax").over(w))
    return run.filter((F.col("running") > limit) & (F.col("running") - F.col("tax") <= limit)).select("user_id", "event_id", "running")


def crossings_of_batches(state: str, path: str, limit: int):
    """For foreachBatch: the crossings of each batch under its number at path, and the vendors' sums after it under its
    number at state. A batch that comes again reads the sums of the one before and writes the same."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "user_id bigint, sum bigint"
        sums = spark.read.schema(schema).parquet(f"{state}/{number - 1}") if number else spark.createDataFrame([], schema)
        threshold_crossings(batch, limit, sums).write.mode("overwrite").parquet(f"{path}/{number}")
        tax = F.round(F.col("value") * 100).cast("bigint")
        new = batch.filter("event_type = 'error'").select("user_id", F.coalesce(tax, F.lit(0)).alias("sum"))
        sums.unionByName(new).groupBy("user_id").agg(F.sum("sum").alias("sum")).write.mode("overwrite").parquet(f"{state}/{number}")

    return apply


def threshold_alerts(events: DataFrame, limit: int, idle: str | None = None) -> DataFrame:
    """user_id, event_id, running: the mismatch events of a stream at which a vendor's running tax exceeds limit and
    didn't before. A vendor's sum is keyed state, which only its own events touch. With idle (such as '90 days'; the
    events then have a watermark on ts) a vendor that sends nothing for longer starts at 0 again, and a timer clears
    its state. Batches come in order of time; a batch's own events of a vendor are put in order. Needs stateful()."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    # A class of its own here, so that it travels to the workers whole.
    class Crossings(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "sum long, last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
            had, last = self.held.get() if self.held.exists() else (0, None)
            at = got["ts"].map(lambda t: int(t.timestamp() * 1000))
            if ms:
                # The sum restarts after a silence, whether its timer has gone off yet or not.
                fresh = at - at.shift(fill_value=at.iloc[0] if last is None else last) > ms
                total = got["tax"].cumsum() + had
                running = total - (total - got["tax"]).where(fresh).ffill().fillna(0).astype("int64")
                if last is not None:
                    self.handle.deleteTimer(last + ms)
                self.handle.registerTimer(int(at.iloc[-1]) + ms)
            else:
                running = had + got["tax"].cumsum()
            self.held.update((int(running.iloc[-1]), int(at.iloc[-1])))
            out = got.assign(running=running)[(running > limit) & (running - got["tax"] <= limit)]
            yield out[["user_id", "event_id", "running"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.held.clear()
            yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "running": pd.Series(dtype="int64")})

        def close(self) -> None:
            pass

    bad = events.filter("event_type = 'error'").select("user_id", "event_id", "ts", F.coalesce("tax", F.lit(0)).alias("tax"))
    schema = "user_id bigint, event_id bigint, running bigint"
    return bad.groupBy("user_id").transformWithStateInPandas(Crossings(), schema, "Append", "EventTime" if ms else "None")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as keyed state needs, in the shared checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def alerts(invoices: DataFrame) -> DataFrame:
    return explain.invoice_alerts(invoices).select("invoice_id", "type", "message", "icon")



"""Structured Streaming versions of the daily and weekly summaries, the alert cool-down, the
outbox and the session log. Each job is a transformation of a streaming frame; ``drain`` runs it
over everything available and returns what it wrote."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wastelens.session import shared_dir


END = dt.datetime(2200, 1, 1)
HOUR = 3_600_000_000  # microseconds
BUCKET = 6 * HOUR  # of waiting events, decided together
KEYS = ["tipo", "usuario", "vacios"]  # keys without nulls: ``vacios`` says which of the two was one
MARK = 4  # in ``vacios``: no event
SLOTS = 128  # keys of state, each with many alert keys; fixed for the life of a checkpoint
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, root: str, files_per_trigger: int = 100, marks: str | None = None) -> DataFrame:
    """The event log as a file stream, with an explicit schema.

    ``marks`` is a folder of closing marks that :func:`drain` writes to when a log has ended.
    """
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    stream = files.option("pathGlobFilter", "events*.parquet").parquet(root)
    if marks:
        spark.createDataFrame([], schema).write.mode("append").parquet(marks)
        stream = stream.union(spark.readStream.schema(schema).parquet(marks))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and value per type and day; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("v"), "event_type").agg(
        F.count("*").alias("eventos"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("valor")
    ).select(F.to_date("v.start").alias("dia"), "event_type", "eventos", "valor")


def weekly_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The same over seven days, sliding by one."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("v"), "event_type").agg(
        F.count("*").alias("eventos"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("valor")
    ).select(F.to_date("v.start").alias("desde"), F.to_date("v.end").alias("hasta"), "event_type", "eventos", "valor")


def packed(rows) -> bytes:
    """A pandas frame of waiting events as Arrow bytes: one value of state however many they are."""
    import pyarrow as pa

    batch, out = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[tuple]:
    """The rows of such a frame."""
    import pyarrow as pa

    columns = pa.ipc.open_stream(data).read_all().to_pydict().values()
    return list(zip(*columns, strict=True))


class CoolDown(StatefulProcessor):
    """Accepts an alert if the last accepted one of its key is at least ``hours`` older; a key of state is a slot of many such keys.

    Waiting events lie in a map state by bucket of event time, in parts that are written once: a batch adds parts with its own
    events and reads no others. A timer at the end of a bucket decides and removes that bucket alone, so
    neither work nor memory grows with what else a slot has waiting. The calls of state follow the slots and buckets, not the
    events or their keys. Beside them a slot holds the last accepted times whose pause has not ended.
    """

    def __init__(self, hours: int, bucket: int = BUCKET):
        self.pause, self.bucket = hours * HOUR, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("ultimos", "filas binary")
        self.parts = handle.getMapState("partes", "tramo long", "n int")
        self.waiting = handle.getMapState("esperan", "tramo long, parte int", "filas binary")

    def _due(self, bucket: int) -> int:
        """The millisecond at which a bucket has ended."""
        return (bucket + 1) * self.bucket // 1000

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            batch = batch[batch["vacios"] < MARK]  # a closing mark only moves the watermark
            for number, new in batch.groupby(batch["us"] // self.bucket):
                bucket = int(number)
                held = self.parts.getValue((bucket,))
                part = held[0] if held else 0
                self.waiting.updateValue((bucket, part), (packed(new[["us", "event_id", *KEYS]]),))
                self.parts.updateValue((bucket,), (part + 1,))
                if not part:
                    self.handle.registerTimer(self._due(bucket))
        return iter(())

    def _taken(self, bucket: int) -> list[tuple]:
        """The events of a bucket in order; they leave the state."""
        held, out = self.parts.getValue((bucket,)), []
        for part in range(held[0] if held else 0):
            out += unpacked(self.waiting.getValue((bucket, part))[0])
            self.waiting.removeKey((bucket, part))
        if held:
            self.parts.removeKey((bucket,))
        return sorted(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        ended = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = self.last.get()
        last = {tuple(alert): us for *alert, us in unpacked(held[0])} if held else {}
        out = []
        for us, event_id, *alert in self._taken(ended // self.bucket - 1):
            before = last.get(tuple(alert))
            if before is None or us >= before + self.pause:
                last[tuple(alert)] = us
                out.append((event_id, *alert, us))
        paused = [(*alert, us) for alert, us in last.items() if us + self.pause > ended]  # of others an event is accepted anyway
        if paused:
            self.last.update((packed(pd.DataFrame(paused, columns=[*KEYS, "us"])),))
            self.handle.registerTimer(self._due((max(row[-1] for row in paused) + self.pause - 1) // self.bucket))
        elif held:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["event_id", *KEYS, "us"])

    def close(self) -> None:
        pass


def cooled_alerts(events: DataFrame, hours: int = 24, late: str = "1 day") -> DataFrame:
    """Alerts of a (type, user) in order of event time: one is accepted if the last accepted one is at least ``hours`` older.

    Events wait in the state of their slot, a hash of their key, until the watermark has passed their bucket, so the result does not
    depend on how they are dealt into files or batches; equal times are taken in order of id. The session needs the
    state store ``ROCKSDB`` when the stream starts; :func:`drain` sets it.
    """
    absent = F.col("event_id").isNull() | F.col("ts").isNull()
    empty = F.col("event_type").isNull().cast("int") + 2 * F.col("user_id").isNull().cast("int") + MARK * absent.cast("int")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))  # noqa: E731  nulls would make floats of them in pandas
    timed = events.withWatermark("ts", late).select(
        number("event_id").alias("event_id"), "ts", F.coalesce("event_type", F.lit("")).alias("tipo"), number("user_id").alias("usuario"),
        empty.alias("vacios"), number(F.unix_micros("ts")).alias("us"))
    slot = F.pmod(F.hash(*KEYS), F.lit(SLOTS)).alias("casilla")
    out = timed.select("*", slot).groupBy("casilla").transformWithStateInPandas(
        CoolDown(hours), "event_id long, tipo string, usuario long, vacios int, us long", "Append", "EventTime")
    return out.select(
        "event_id", F.when(F.col("vacios") % 2 == 0, F.col("tipo")).alias("event_type"),
        F.when(F.col("vacios") < 2, F.col("usuario")).alias("user_id"), F.timestamp_micros("us").alias("ts"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """User sessions: activity without a pause longer than ``gap``."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("eventos")).select("user_id", F.col("s.start").alias("inicio"), F.col("s.end").alias("fin"), "eventos")


def drain(stream: DataFrame, purpose: str, marks: str | None = None) -> DataFrame:
    """Process all available input into a Parquet table of the shared folder and read it.

    With ``marks`` the log counts as ended: a second run reads a closing mark that moves the watermark past
    everything, so that windows, sessions and waiting events still open are written too. State is kept in ``ROCKSDB``, on
    the executors' disks with its changes in the checkpoint.
    """
    spark, out = stream.sparkSession, shared_dir(stream.sparkSession, purpose)

    def run() -> None:
        before = spark.conf.get(PROVIDER, None)
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/datos").option(
                "checkpointLocation", f"{out}/control").trigger(availableNow=True).start().awaitTermination()
        finally:
            if before is None:
                spark.conf.unset(PROVIDER)
            else:
                spark.conf.set(PROVIDER, before)

    run()
    if marks:
        schema = spark.read.parquet(marks).schema
        kind = schema["ts"].dataType
        mark = spark.range(1).select(*[F.lit(END).cast(kind).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
                                       for f in schema.fields])
        mark.write.mode("append").parquet(marks)
        run()
    return spark.read.schema(stream.schema).parquet(f"{out}/datos")


def to_outbox(stream: DataFrame, outbox: str, control: str, deliver: Callable[[DataFrame], DataFrame] | None = None):
    """Append every micro-batch to the outbox with its delivery flag.

    ``deliver`` maps a batch to the same rows with a boolean ``enviado``; without it nothing is
    sent and all rows stay to be resent. The batch id is part of the path, so a batch that is
    run again after a failure replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = deliver(batch) if deliver else batch.withColumn("enviado", F.lit(False))
        rows.write.mode("overwrite").parquet(f"{outbox}/lote={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", control).trigger(availableNow=True).start()

"""Structured Streaming versions of the append and alert jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.alerts import rule_index
from tessera.sources.tables import append_last_wins, exists

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(number, days) of the batches that are part of the table."""
    return spark.read.schema("number long, days array<string>").json(f"{path}/ledger") if exists(spark, f"{path}/ledger") else None


def _commit(spark: SparkSession, path: str, number: int, days: list[str]) -> None:
    """Writes a batch's entry beside the ledger and moves it in: the move is what makes the batch part of the table."""
    jvm = spark.sparkContext._jvm
    made, at = (jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/{number}.json") for folder in ("pending", "ledger"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(made, True)
    out.write(bytearray(f'{{"number": {number}, "days": [{", ".join(f"{chr(34)}{d}{chr(34)}" for d in days)}]}}', "utf-8"))
    out.close()
    fs.mkdirs(at.getParent())
    if not fs.rename(made, at) and not fs.exists(at):
        raise OSError(f"batch {number} could not be added to the ledger of {path}")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that append_stream keeps: every day as the last batch that touched it left it; None before the first batch."""
    ledger = _ledger(spark, path)
    if ledger is None:
        return None
    newest = ledger.select("number", F.explode("days").alias("day")).groupBy("day").agg(F.max("number").alias("number")).collect()  # a row for each day
    return spark.read.parquet(*[f"{path}/versions/{r.number}/_day={r.day}" for r in newest]) if newest else None


def append_stream(stream: DataFrame, path: str, keys: list[str], time: str, seq: str = "seq", delay: str = "10 minutes"):
    """Arriving rows into a table by day, last write wins: repeats of a row are dropped inside the watermark, then each batch is merged into the days it touches. ``current`` reads the table.

    keys hold the time, so rows of one key share a day. A batch writes the days that it touches as a version of its own
    and becomes part of the table by one move of its ledger entry: readers see all of its days or none, a batch that
    fails before is written anew, and one that is already in the ledger is left alone. Its cost follows the days, not
    the table. ``vacuum`` deletes versions that later ones replace.
    """
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, seq])

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = _ledger(spark, path)
        if ledger is not None and not ledger.where(F.col("number") == number).isEmpty():
            batch.write.format("noop").mode("overwrite").save()  # its state must be committed all the same
            return
        new = batch.withColumn("day", F.to_date(time)).persist()  # read twice, and its duplicates cost state to find
        try:
            days = [str(r.day) for r in new.where("day IS NOT NULL").select("day").distinct().collect()]
            if not days:
                return
            table = current(spark, path)
            old = new.limit(0) if table is None else table.where(F.col("day").isin(*days))
            merged = append_last_wins(old.select(*new.columns), new.where("day IS NOT NULL"), keys, seq)
            merged.withColumn("_day", F.col("day")).write.partitionBy("_day").mode("overwrite").parquet(f"{path}/versions/{number}")
            _commit(spark, path, number, days)
        finally:
            new.unpersist()

    return once.writeStream.foreachBatch(merge)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the days of versions that later batches have replaced, and returns how many. Run it while no reader holds an older ``current``."""
    ledger = _ledger(spark, path)
    if ledger is None:
        return 0
    each = ledger.select("number", F.explode("days").alias("day"))
    newest = each.groupBy("day").agg(F.max("number").alias("newest"))
    gone = each.join(newest, "day").where("number < newest").collect()  # a row for each replaced day
    jvm = spark.sparkContext._jvm
    done = 0
    for r in gone:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{r.number}/_day={r.day}")
        done += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return done


def level_alerts(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """R02, stateless: arriving rows (entity, ts, price) that cross a rule's level; rules (rule_id, target, side, level) are a static table of any size.

    Rules with a target meet their entity's rows by an equal key; those for all ('*') are found by their levels in an
    index (see ``alerts.rule_index``) that is made when the stream is set up.
    """
    rows = stream.select("entity", "ts", "price")
    named = rows.withColumn("target", F.col("entity").cast("string")).join(rules.where("target <> '*'"), "target").select("entity", "ts", "price", "rule_id", "side", "level")
    signed = lambda c: F.when(F.col("side") == "above", F.col(c)).otherwise(-F.col(c))
    index = rule_index(rules.where("target = '*'"), ["side"], signed("level"), ["rule_id", "level"])
    both = rows.withColumn("side", F.explode(F.array(F.lit("above"), F.lit("below")))).withColumn("_measure", signed("price"))
    every = index.search(both, "_measure").select("entity", "ts", "price", "rule_id", "side", "level")
    hit = F.when(F.col("side") == "above", F.col("price") > F.col("level")).otherwise(F.col("price") < F.col("level"))
    return named.unionByName(every).where(hit).select("rule_id", "entity", "ts", "price", "level")


class _Means(StatefulProcessor):
    """Per entity: its last prices, the newest time seen, and an event-time timer that clears both when the entity falls silent."""

    def __init__(self, rows: int, idle_ms: int):
        self.rows, self.idle_ms = rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "price double")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        ms = df["ts"].to_numpy("datetime64[ms]").astype(np.int64)
        before = self.newest.get()[0] if self.newest.exists() else None
        fresh = np.ones(len(df), bool) if before is None else ms > before  # what comes late enters no mean
        df, ms = df[fresh], ms[fresh]
        if not len(df):
            return
        old = np.array([r[0] for r in self.held.get()] if self.held.exists() else [], float)
        every = np.concatenate([old, df["price"].to_numpy(float)])
        sums = np.concatenate([[0.0], np.cumsum(every)])
        at = np.arange(len(old), len(every))
        full = at >= self.rows
        mean = np.where(full, (sums[at] - sums[np.maximum(at - self.rows, 0)]) / self.rows, np.nan)
        hit = full & (every[at] > mean)
        if before is not None:
            self.handle.deleteTimer(before + self.idle_ms)
        self.handle.registerTimer(int(ms[-1]) + self.idle_ms)
        self.newest.update((int(ms[-1]),))
        self.held.put([(float(x),) for x in every[-self.rows :]])
        if hit.any():
            yield pd.DataFrame({"entity": [key[0]] * int(hit.sum()), "ts": df["ts"].to_numpy()[hit], "price": every[at][hit], "mean": mean[hit]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def mean_alerts(stream: DataFrame, rows: int, idle: str = "7 days", delay: str = "10 minutes") -> DataFrame:
    """R02 over n rows: an alert where a price exceeds the mean of the entity's last ``rows`` prices; nothing before so many were seen.

    State per entity: its last prices and newest time. Rows of a batch are taken in event-time order; a row that isn't
    newer than all before it comes too late: it raises no alert and enters no mean. An entity without rows for ``idle``
    of event time loses its state and begins anew. The state needs the RocksDB store, which is set for the session here.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    kind = dict(stream.dtypes)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    keyed = stream.select("entity", "ts", F.col("price").cast("double").alias("price")).withWatermark("ts", delay).groupBy("entity")
    return keyed.transformWithStateInPandas(statefulProcessor=_Means(rows, idle_ms), outputStructType=f"entity {kind['entity']}, ts {kind['ts']}, price double, mean double", outputMode="Append", timeMode="EventTime")


def bars(ticks: DataFrame, entity: str, time: str, price: str, qty: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Last price and summed quantity per tumbling window; rows later than the watermark are dropped."""
    g = ticks.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), entity)
    return g.agg(F.max_by(price, time).alias("price"), F.sum(qty).alias("qty"), F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), "price", "qty", "n")


def spells(events: DataFrame, entity: str, time: str, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Sessions of rows that lie no further apart than the gap."""
    g = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), entity)
    return g.agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_stream(df: DataFrame, folder: str, run: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """Writes df into ``folder`` and drives it through a streaming query into an in-memory table: for tests and small replays."""
    df.write.mode("overwrite").parquet(folder)
    spark = df.sparkSession
    query = run(spark.readStream.schema(df.schema).parquet(folder)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)

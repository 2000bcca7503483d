"""Streams that are stopped, run again, late or silent."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException

from tessera.streaming import panels

T0 = dt.datetime(2024, 1, 1)
ROWS = "entity int, ts timestamp, price double, seq int"


def hour(h):
    return T0 + dt.timedelta(hours=h)


class Feed:
    """A folder of arriving files, and a query over it that is started again for each."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.at, self.n = spark, schema, tempfile.mkdtemp(prefix="spark-"), 0
        os.mkdir(f"{self.at}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/in")

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.at}/in")

    def run(self, writer):
        q = writer.trigger(availableNow=True).option("checkpointLocation", f"{self.at}/cp").start()
        q.awaitTermination()
        return q

    def alerts(self, rows, idle="7 days", delay="0 seconds"):
        out = panels.mean_alerts(self.stream(), rows, idle, delay)
        self.run(out.writeStream.format("parquet").option("path", f"{self.at}/out").outputMode("append"))
        return sorted((r.entity, r.ts, r.price, r.mean) for r in self.spark.read.parquet(f"{self.at}/out").collect())


def test_mean_alerts_go_on_after_a_restart_and_leave_late_rows_out(spark):
    f = Feed(spark, "entity int, ts timestamp, price double")
    f.add([(1, hour(h), float(h)) for h in (0, 2, 1)] + [(2, hour(0), 5.0)])
    assert f.alerts(3) == []
    f.add([(1, hour(3), 3.0)])
    assert f.alerts(3) == [(1, hour(3), 3.0, 1.0)]
    f.add([(1, hour(2), 99.0), (1, hour(3), 99.0)])  # not newer than the last one
    assert len(f.alerts(3)) == 1
    f.add([(1, hour(4), 1.0), (1, hour(5), 2.5), (2, hour(4), 6.0)])
    assert f.alerts(3) == [(1, hour(3), 3.0, 1.0), (1, hour(5), 2.5, 2.0)]


def test_mean_alerts_forget_silent_entities(spark):
    f = Feed(spark, "entity int, ts timestamp, price double")
    f.add([(1, hour(0), 1.0), (1, hour(1), 1.0)])
    f.alerts(2, "5 hours")
    f.add([(2, hour(20), 1.0)])
    f.alerts(2, "5 hours")
    f.add([(2, hour(21), 1.0)])
    f.alerts(2, "5 hours")  # the watermark has passed the timer of entity 1
    f.add([(1, hour(22), 9.0), (2, hour(22), 9.0)])
    assert f.alerts(2, "5 hours") == [(2, hour(22), 9.0, 1.0)]


def test_appends_survive_a_crash_between_data_and_ledger(spark, monkeypatch):
    f = Feed(spark, ROWS)
    make = lambda: panels.append_stream(f.stream(), f"{f.at}/out", ["entity", "ts"], "ts")
    f.add([(1, hour(0), 1.0, 1), (1, hour(30), 2.0, 1)])
    f.run(make())
    seen = lambda: sorted((r.entity, r.ts, r.price) for r in panels.current(spark, f"{f.at}/out").collect())
    assert seen() == [(1, hour(0), 1.0), (1, hour(30), 2.0)]
    f.add([(1, hour(30), 7.0, 2), (2, hour(31), 3.0, 1)])

    def crash(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(panels, "_commit", crash)
        with pytest.raises(StreamingQueryException):
            f.run(make())
    assert seen() == [(1, hour(0), 1.0), (1, hour(30), 2.0)]  # nothing of the half batch shows
    f.run(make())
    assert seen() == [(1, hour(0), 1.0), (1, hour(30), 7.0), (2, hour(31), 3.0)]
    assert panels.vacuum(spark, f"{f.at}/out") == 1 and panels.vacuum(spark, f"{f.at}/out") == 0
    assert seen() == [(1, hour(0), 1.0), (1, hour(30), 7.0), (2, hour(31), 3.0)]


def test_a_batch_in_the_ledger_is_not_written_again(spark, monkeypatch):
    f = Feed(spark, ROWS)
    f.add([(1, hour(0), 1.0, 1)])
    real = panels._commit

    def late_crash(*a):
        real(*a)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(panels, "_commit", late_crash)
        with pytest.raises(StreamingQueryException):
            f.run(panels.append_stream(f.stream(), f"{f.at}/out", ["entity", "ts"], "ts"))
    files = panels.current(spark, f"{f.at}/out").inputFiles()
    f.run(panels.append_stream(f.stream(), f"{f.at}/out", ["entity", "ts"], "ts"))
    assert panels.current(spark, f"{f.at}/out").inputFiles() == files
    assert panels.current(spark, tempfile.mkdtemp(prefix="spark-")) is None


def test_many_rules_for_all_entities(spark):
    n = 100_000
    rules = spark.range(0, n).selectExpr("concat('u', id) AS rule_id", "'*' AS target", "'above' AS side", f"double(id) * 1000 / {n} AS level").unionByName(spark.createDataFrame([("lo", "*", "below", 0.5), ("t", "7", "above", 998.0)], "rule_id string, target string, side string, level double"))
    rows = spark.createDataFrame([(1, hour(0), 0.025), (2, hour(0), 0.0), (7, hour(0), 998.5), (8, hour(0), None)], "entity int, ts timestamp, price double")
    got = panels.level_alerts(rows, rules)
    count = {r.entity: r["count"] for r in got.groupBy("entity").count().collect()}
    # 0.025 lies over levels 0, 0.01 and 0.02 and under 0.5; 998.5 over 99,850 levels and its own rule
    assert count == {1: 4, 2: 1, 7: 99_851}
    f = Feed(spark, "entity int, ts timestamp, price double")
    live = panels.as_stream(rows.where("entity < 7"), f"{f.at}/x", lambda s: panels.level_alerts(s, rules), "live_many")
    assert sorted((r.rule_id, r.entity) for r in live.collect()) == [("lo", 1), ("lo", 2), ("u0", 1), ("u1", 1), ("u2", 1)]


def test_many_batch_rules_cost_a_search(spark):
    from tessera.operators import alerts

    n = 100_000
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(4)]
    panel = spark.createDataFrame([(e, d, 100.0 + e + i, 10.0) for e in (1, 2) for i, d in enumerate(days)], "entity int, date date, price double, qty double")
    rules = spark.range(0, n).selectExpr("concat('r', id) AS rule_id", "IF(id % 2 = 0, 'price_above', 'price_below') AS rule_type", "'*' AS target", "IF(id % 2 = 0, 104D + id, 104D - id) AS p1", "CAST(NULL AS DOUBLE) AS p2")
    more = spark.createDataFrame([("c", "pct_above", "*", 2.8, 3.0), ("v", "volume_spike", "*", 1.0, 3.0), ("h", "new_high", "2", 3.0, None), ("x", "new_high", "*", 9.0, None), ("n", "price_above", "*", None, None)], "rule_id string, rule_type string, target string, p1 double, p2 double")
    got = sorted((r.rule_id, r.entity) for r in alerts.evaluate(rules.unionByName(more), panel).collect())
    # newest prices 104 and 105: above 104 for the second only; below 104 - id for none
    assert got == [("c", 1), ("c", 2), ("h", 2), ("r0", 2), ("v", 1), ("v", 2)]
    metrics = spark.createDataFrame([(1, 5.0, None), (2, 9.0, 1.0)], "entity int, a double, b double")
    many = spark.range(0, n).selectExpr("concat('m', id) AS rule_id", "IF(id % 2 = 0, 'all', 'any') AS match", "concat('a>=', 8 + id, ';b==', id) AS conditions")
    hit = sorted((r.rule_id, r.entity, r.value) for r in alerts.conditions(many, metrics, ["a", "b"]).collect())
    assert hit == [("m1", 2, 1.0)]
    two = spark.createDataFrame([("p", "any", "a<9;a<=9;b>1;b>=1;zz<1"), ("q", "all", "a<=5")], many.schema)
    assert sorted((r.rule_id, r.entity, r.value) for r in alerts.conditions(two, metrics, ["a", "b"]).collect()) == [("p", 1, 0.5), ("p", 2, 0.5), ("q", 1, 1.0)]

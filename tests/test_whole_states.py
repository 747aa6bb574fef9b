"""The state of bars costs by the window and group, whatever symbols there are; batches of several files arrive whole."""

import math

from pyspark.sql import functions as F

from panelforge.plans import stream_queries
from panelforge.sources import shared
from panelforge.sources.versioned import Table
from panelforge.streaming import bars

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def test_state_of_many_symbols_is_few_lists(spark):
    """3,000 symbols of one day were 3,000 rows of state and as many timers, each called for by itself."""
    path, out, check = (shared.scratch(spark, x) for x in ("events", "bars", "ck"))
    own = spark.range(9000).select(F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01 06:00:00' + make_interval(0, 0, 0, 0, 0, id div 3000)").alias("ts"), (F.col("id") % 3000 - 1500).alias("user_id"), F.expr("double(id * 7919 % 9001)").alias("value"))
    own.coalesce(1).write.parquet(path)
    made = bars.bars_from_events(bars.read_files(spark, path, SCHEMA))
    held = bars.run_available(made, check, path=out)
    assert 0 < bars.state_rows(held) < 1500
    spark.sql("SELECT -1L AS event_id, timestamp'2024-02-01 00:00:00' AS ts, -1L AS user_id, 0D AS value").coalesce(1).write.mode("append").parquet(path)
    assert bars.state_rows(bars.run_available(made, check, path=out)) < 10
    got = {(r.sym, r.open, r.high, r.low, r.close, r.n) for r in spark.read.parquet(out).where("kind = 'bar' and start < '2024-01-02'").collect()}
    of = [[float((k * 3000 + s) * 7919 % 9001) for k in range(3)] for s in range(3000)]
    assert got == {(s - 1500, v[0], max(v), min(v), v[2], 3) for s, v in enumerate(of)}


def test_state_that_grows_batch_by_batch_is_merged(spark):
    """Nulls, repeated keys and a window that many batches add to; late events keep null and NaN apart, and may lack an id."""
    path, check, table = shared.scratch(spark, "events"), shared.scratch(spark, "ck"), Table(spark, shared.scratch(spark, "bars"))

    def arrive(*own):
        spark.sql(" UNION ALL ".join(f"SELECT {i}L AS event_id, timestamp'{t}' AS ts, {u} AS user_id, double({v}) AS value" if i is not None else f"SELECT NULL, timestamp'{t}', {u}, double({v})" for i, t, u, v in own)).selectExpr("event_id", "ts", "cast(user_id as long) as user_id", "value").coalesce(1).write.mode("append").parquet(path)

    for k in range(8):
        arrive((k, f"2024-01-01 10:0{7 - k}:00", 1, k), (10 + k, "2024-01-01 11:00:00", 1, f"1{k}"), (20, "2024-01-01 12:00:00", 2, 5), (20, "2024-01-01 12:00:00", 2, 5))
    arrive((30, "2024-01-01 09:00:00", 3, "NULL"), (31, "2024-01-01 09:01:00", 3, "'NaN'"), (32, "2024-01-05 00:00:00", 9, 1))
    arrive((40, "2024-01-01 09:00:00", 1, "NULL"), (41, "2024-01-01 09:00:00", 1, "'NaN'"), (None, "2024-01-01 09:00:00", 2, 3), (None, "2024-01-05 00:00:00", 9, 2), (50, "2024-01-20 00:00:00", 9, 0))
    bars.run_available(bars.bars_from_events(bars.read_files(spark, path, SCHEMA, files=1)), check, sink=bars.commit_into(table, "bars"))
    got = table.read().collect()
    assert sorted((r.sym, r.start.day, r.open, r.high, r.low, r.close, r.n) for r in got if r.kind == "bar" and r.sym < 3) == [(1, 1, 7.0, 17.0, 0.0, 17.0, 16), (2, 1, 5.0, 5.0, 5.0, 5.0, 16)]
    assert [(r.open, r.high, r.low, r.close, r.n) for r in got if r.kind == "bar" and r.sym == 3] == [(None, None, None, None, 2)]
    assert [(r.open, r.close, r.n) for r in got if r.kind == "bar" and r.sym == 9] == [(1.0, 2.0, 2)]
    late = {(r.sym, r.event_id): r.value for r in got if r.kind == "late"}
    assert set(late) == {(1, 40), (1, 41), (2, None)} and late[1, 40] is None and math.isnan(late[1, 41]) and late[2, None] == 3.0


def test_state_has_no_more_partitions_than_asked_for(spark):
    path, shuffled = shared.scratch(spark, "events"), "spark.sql.shuffle.partitions"
    spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01 00:00:00' AS ts, 1L AS user_id, 0D AS value").coalesce(1).write.parquet(path)
    before = spark.conf.get(shuffled)
    for asked, has in ((2, 2), (9, int(before)), (None, int(before))):
        made = bars.bars_from_events(bars.read_files(spark, path, SCHEMA))
        query = bars.run_available(made, shared.scratch(spark, "ck"), path=shared.scratch(spark, "bars"), partitions=asked)
        assert {o["numShufflePartitions"] for p in query.recentProgress for o in p["stateOperators"]} == {has} and spark.conf.get(shuffled) == before


class State:
    """Lists and values as a handle gives them, without a worker."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, []

    getListState = getValueState = lambda self, *_: self

    def get(self):
        return self.value if self.value is not None or not self.rows else iter(self.rows)

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_merged_list_is_at_most_twice_its_bars(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bars, "PIECE", 4)
    own, size, lists = bars._Bars(bars.DAY), State(), State()
    own.handle, own.bars, own.size = State(), lists, size
    lists.put = lambda rows: lists.rows.__setitem__(slice(None), rows)
    lists.appendList = lists.rows.extend
    lists.clear, size.clear = lists.rows.clear, lambda: setattr(size, "value", None)
    size.update = lambda v: setattr(size, "value", v)

    class Before:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    class Block:
        def __init__(self, *events):
            self.block = np.array(list(events), bars.EVENT).tobytes()

    most = 0
    for k in range(50):
        assert not list(own.handleInputRows((0, 0), iter([Block((s, k, k, float(k), 0)) for s in range(3)]), Before))
        most = max(most, sum(len(r[0]) for r in lists.rows) // bars.BAR.itemsize)
    assert most <= 2 * 3 + 4 and own.handle.timers == [bars.DAY // 1000]
    out = list(own.handleExpiredTimer((0, 0), Before, None))
    assert [(r.sym.tolist(), r.open.tolist(), r.close.tolist(), r.high.tolist(), r.low.tolist(), r.n.tolist()) for r in out] == [([0, 1, 2], [0.0] * 3, [49.0] * 3, [49.0] * 3, [0.0] * 3, [50] * 3)]
    assert not lists.rows and size.value is None


def test_batches_of_several_files_have_no_empty_ones(spark, tmp_path):
    events = spark.range(0, 600, 1, 4).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as ts", "id % 7 as user_id", "double(id) as value")
    assert stream_queries.files_each(events, "event_id < 300", "event_id >= 300") == 4
    assert stream_queries.files_each(events, "event_id < 15", "event_id >= 15") == 1  # fewer than 4 x 4
    assert stream_queries.files_each(events.coalesce(1), "event_id < 300", "event_id >= 300") == 1
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    path, _ = stream_queries.arriving(spark, str(tmp_path), "event_id < 300", "event_id >= 300", files=4)
    assert len([n for n in shared.names(spark, path) if n.endswith(".parquet")]) == 8
    out, check = shared.scratch(spark, "out"), shared.scratch(spark, "ck")
    query = bars.run_available(bars.read_files(spark, path, SCHEMA, files=4), check, path=out)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [300, 300] and spark.read.parquet(out).count() == 600

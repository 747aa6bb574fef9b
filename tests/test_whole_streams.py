"""Streams against the whole batch result; versioned tables with readers, two writers and restarts."""

import datetime
import threading

import pytest

from panelforge.operators import upserts
from panelforge.sources import files, shared
from panelforge.sources.versioned import Conflict, Table
from panelforge.streaming import bars

SCHEMA = "sym long, value double, day string"


def rows(df):
    return sorted((r.sym, r.value) for r in df.collect())


def frame(spark, *own, day="2024-01-01"):
    return spark.createDataFrame([(s, v, day) for s, v in own], SCHEMA)


def at(text):
    return text and datetime.datetime.fromisoformat(text)


def test_bars_close_once_and_late_events_stay_whole(spark, tmp_path):
    """Each file is a batch: a second file for an open window, a late one, and a restart before the last."""
    schema = "event_id long, ts timestamp, user_id long, value double"
    path, table, checkpoint = str(tmp_path / "in"), Table(spark, str(tmp_path / "t")), str(tmp_path / "ck")

    def arrive(*own):
        spark.createDataFrame([(i, at(t), u, v) for i, t, u, v in own], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        bars_of = bars.bars_from_events(bars.read_files(spark, path, schema, files=1))
        bars.run_available(bars_of, checkpoint, sink=bars.commit_into(table, "bars"))

    arrive((1, "2024-01-01 09:00", 1, 5.0), (2, "2024-01-01 10:00", 1, 9.0), (3, "2024-01-01 10:00", 2, None))
    arrive((4, "2024-01-01 08:00", 1, 7.0), (5, "2024-01-01 10:00", 1, 1.0), (6, "2024-01-04 10:00", 1, 3.0), (7, None, 1, 1.0), (8, "2024-01-04 10:00", None, 1.0))
    run()
    arrive((9, "2024-01-01 07:00", 1, 99.0), (10, "2024-01-01 07:00", 1, 98.0), (11, "2024-01-04 09:00", 1, 4.0), (12, "2024-01-20 00:00", 5, 0.0))
    run()
    got = table.read().collect()
    key = lambda r: (r.sym, r.start.day, r.open, r.high, r.low, r.close, r.n)
    assert sorted(map(key, (r for r in got if r.kind == "bar")), key=str) == sorted([(1, 1, 7.0, 9.0, 1.0, 1.0, 4), (2, 1, None, None, None, None, 1), (1, 4, 4.0, 4.0, 3.0, 3.0, 2)], key=str)
    assert sorted((r.event_id, r.sym, r.value) for r in got if r.kind == "late") == [(9, 1, 99.0), (10, 1, 98.0)]


def test_readers_pin_a_version_and_one_writer_wins(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(frame(spark, (1, 1.0), (2, 2.0)))
    old = table.read()
    version = table.latest()
    table.update(frame(spark, (2, 5.0)), lambda a, b: upserts.last_wins(a, b, ["sym"]).select(a.columns))
    assert rows(old) == [(1, 1.0), (2, 2.0)] and rows(table.read()) == [(1, 1.0), (2, 5.0)] and rows(table.read(version)) == rows(old)
    with pytest.raises(Conflict):  # has read the old version
        table.replace(frame(spark), version)
    made, lost = [], []

    def write(k):
        try:
            made.append(table.replace(frame(spark, (k, 0.0)), 2))
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made == [3] and len(lost) == 4
    more = [threading.Thread(target=lambda k=k: table.update(frame(spark, (10 + k, 1.0)), lambda a, b: a.unionByName(b), attempts=9)) for k in range(3)]
    for t in more:
        t.start()
    for t in more:
        t.join()
    assert len(rows(table.read())) == 4 and table.latest() == 6  # none is lost
    assert table.vacuum(keep=1) >= 5 and len(rows(table.read())) == 4


def test_partitions_change_in_one_version(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "day")
    one = frame(spark, (1, 1.0)).unionByName(frame(spark, (2, 2.0), day="a b/c")).unionByName(frame(spark, (3, 3.0), day=None))
    table.replace(one)
    before = {p["key"]: p["folder"] for p in table.manifest()["parts"]}
    table.update(frame(spark, (9, 9.0), day="a b/c").unionByName(frame(spark, (8, 8.0), day=None)), lambda a, b: upserts.last_wins(a, b, ["sym"]).select(a.columns))
    after = {p["key"]: p["folder"] for p in table.manifest()["parts"]}
    assert rows(table.read()) == [(1, 1.0), (2, 2.0), (3, 3.0), (8, 8.0), (9, 9.0)]
    assert {k for k in before if before[k] == after[k]} == {"2024-01-01"}
    table.replace_parts(frame(spark, (7, 7.0), day="a b/c"))
    assert rows(table.read()) == [(1, 1.0), (3, 3.0), (7, 7.0), (8, 8.0)] and {r.day for r in table.read().collect()} == {"2024-01-01", "a b/c", None}


def test_a_stream_repeats_nothing_and_leaves_nothing_out(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    sink = bars.commit_into(table, "s", order="day", next_of=lambda last: at(last).date() + datetime.timedelta(days=1))
    batch = lambda day, *own: frame(spark, *own, day=day)
    sink(batch("2024-01-01", (1, 1.0)), 0)
    sink(batch("2024-01-01", (1, 1.0)), 0)  # the same query again: it failed before its checkpoint
    assert rows(table.read()) == [(1, 1.0)] and table.latest() == 1
    sink(batch("2024-01-02", (2, 2.0)), 1)
    for day in ("2024-01-02", "2024-01-04"):
        with pytest.raises(bars.Refused):
            sink(batch(day, (3, 3.0)), 2)
    assert table.manifest()["streams"]["s"]["last"] == "2024-01-02" and table.latest() == 2
    sink(batch("2024-01-03"), 2)  # an empty batch moves the number alone
    sink(batch("2024-01-03", (3, 3.0)), 3)
    assert rows(table.read()) == [(1, 1.0), (2, 2.0), (3, 3.0)] and table.manifest()["streams"]["s"] | {"query": 0} == {"query": 0, "batch": 3, "last": "2024-01-03", "rows": 3}


def test_compaction_beside_a_stream(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    sink = bars.commit_into(table, "s")
    for k in range(3):
        sink(frame(spark, (k % 2, float(k)), day=str(k)), k)

    def fold(df):
        sink(frame(spark, (7, 7.0), day="3"), 3)  # a batch comes meanwhile
        return bars.folded(df, ["sym"], ["value"], "day")

    table.compact(fold)
    assert len(table.manifest()["parts"]) == 2 and rows(table.read()) == [(0, 2.0), (1, 1.0), (7, 7.0)]
    sink(frame(spark, (7, 7.0), day="3"), 3)
    assert len(table.manifest()["parts"]) == 2  # progress survives compaction


def test_only_changed_files_are_read_again(spark, tmp_path):
    source, cache = tmp_path / "src", str(tmp_path / "cache")
    for k in range(3):
        frame(spark, (k, float(k))).coalesce(1).write.parquet(str(source / str(k)))
    read = lambda paths: spark.read.schema(SCHEMA).parquet(*paths)
    look = lambda: (lambda df, n: (rows(df), n))(*files.refreshed(spark, f"{source}/*/*.parquet", cache, read))
    assert look() == ([(0, 0.0), (1, 1.0), (2, 2.0)], 3) and look()[1] == 0
    frame(spark, (1, 5.0), (6, 6.0)).coalesce(1).write.mode("overwrite").parquet(str(source / "1"))
    assert look() == ([(0, 0.0), (1, 5.0), (2, 2.0), (6, 6.0)], 1)
    shared.remove(spark, str(source / "0"))
    assert look() == ([(1, 5.0), (2, 2.0), (6, 6.0)], 0)


def test_purge(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.replace(frame(spark, (1, 1.0), (2, 2.0), (3, 3.0)))
    keep = lambda *own: spark.createDataFrame([(k,) for k in own], "sym long")
    assert upserts.purge_table(table, keep(), keep(9)) == (3, 3) and table.latest() == 1
    assert upserts.purge_table(table, keep(1), keep(3)) == (3, 2) and rows(table.read()) == [(1, 1.0), (3, 3.0)]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, value double"
    for k, day in enumerate(("2024-01-10", "2024-01-10", "2024-01-01", "2024-01-11")):
        spark.sql(f"select {k // 2 * 2 + k // 3}L event_id, timestamp'{day} 10:00:00' ts, 1L user_id, 2.0D value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = Table(spark, str(tmp_path / "t"))
    unique = bars.fresh(bars.read_files(spark, str(tmp_path / "in"), schema, files=1), ["event_id"])
    query = bars.run_available(unique, str(tmp_path / "ck"), sink=bars.commit_into(table, "u"))
    assert bars.late_rows(query) == 1 and table.read().count() == 2 and bars.state_rows(query) == 2


def test_the_panel_follows_its_inputs(spark, sf_dir, tmp_path):
    import shutil

    from panelforge.operators import panel

    for t in panel.INPUTS:
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    old = panel.standard(spark, str(tmp_path)).count()
    half = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey % 2 = 0").toPandas()
    half.to_parquet(f"{tmp_path}/lineitem.parquet", coerce_timestamps="us")
    panel_then = {r.sym for r in panel.standard(spark, str(tmp_path)).where("close is not null").select("sym").distinct().collect()}
    assert old and all(s % 2 == 0 for s in panel_then)

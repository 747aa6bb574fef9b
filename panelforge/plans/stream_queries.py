"""Streaming queries over the events table: each runs the stream over what is there and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import digits
from panelforge.plans.registry import query
from panelforge.sources import fixtures
from panelforge.sources.shared import scratch
from panelforge.sources.versioned import Table
from panelforge.streaming import bars as st

#: Of the events one in so many comes only at the very end.
DELAYED = 97
#: Partitions of state, if no more tasks read the events.
FEWEST = 8


def arrivals(spark, sf_dir):
    """The events that arrive."""
    return fixtures.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


def arriving(spark, sf_dir, *batches, files=1):
    """A folder of files, ``files`` a batch (each a condition on the events), in the order of their times; and the files' schema."""
    own = arrivals(spark, sf_dir)
    path = scratch(spark, "events")
    for b in batches:
        batch = own.where(b) if isinstance(b, str) else b(own)
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(path)
    return path, own.schema


def files_each(own, *batches):
    """Files that each batch can be written in, none of them empty: as many as tasks read ``own``, or one.

    Rows are dealt out in turn by each of these tasks, so one of them has rows for all files if there are ``files`` squared.
    """
    files = own.rdd.getNumPartitions()
    if files > 1 and min(own.agg(*(F.count_if(F.expr(b)) for b in batches)).first()) >= files**2:
        return files
    return 1


def bar_stream(spark, path, schema, table, checkpoint, files=1):
    """The bars of all that has arrived, ``files`` files a batch, and the query that made them."""
    own = st.bars_from_events(st.read_files(spark, path, schema, files=files))
    return st.run_available(own, checkpoint, sink=st.commit_into(table, "bars"), partitions=max(files, FEWEST))


@query("stream_bar_agg", f"""WITH t AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events WHERE event_id % {DELAYED} <> 0),
e AS (SELECT *, event_id % {DELAYED} = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark AS late FROM events, t)
SELECT user_id AS sym, strftime(ts, '%Y-%m-%d') AS start, round(arg_min(value, (ts, event_id)) FILTER (NOT late), 6) + 0.0 AS open, round(max(value) FILTER (NOT late), 6) + 0.0 AS high, round(min(value) FILTER (NOT late), 6) + 0.0 AS low,
  round(arg_max(value, (ts, event_id)) FILTER (NOT late), 6) + 0.0 AS close, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late FROM e GROUP BY 1, 2""")  # fmt: skip
def stream_bar_agg(spark, sf_dir):
    """Three batches of files by time, then events that come at the very end, most of them late; a last event far ahead closes all windows.

    The stream is stopped before that event and goes on from its checkpoint.
    """
    edges = fixtures.read(spark, sf_dir, "events").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b")).first()
    third = (edges.b - edges.a) / 3
    cuts = [f"timestamp'{edges.a + third * k}'" for k in (1, 2)]
    on_time = f"event_id % {DELAYED} <> 0"
    batches = f"{on_time} and ts < {cuts[0]}", f"{on_time} and ts >= {cuts[0]} and ts < {cuts[1]}", f"{on_time} and ts >= {cuts[1]}", f"event_id % {DELAYED} = 0"
    files = files_each(arrivals(spark, sf_dir), *batches)
    path, schema = arriving(spark, sf_dir, *batches, files=files)
    table, checkpoint = Table(spark, scratch(spark, "bars")), scratch(spark, "ck")
    bar_stream(spark, path, schema, table, checkpoint, files)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(edges.b) + F.expr("interval 9 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    spark.createDataFrame(end.collect(), schema).coalesce(1).write.mode("append").parquet(path)
    bar_stream(spark, path, schema, table, checkpoint, files)
    rows = table.read()
    bars = rows.where("kind = 'bar'").select("sym", "start", *(digits(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), "n")
    late = rows.where("kind = 'late'").groupBy("sym", "start").agg(F.count(F.lit(1)).alias("n_late"))
    return bars.join(late, ["sym", "start"], "full").withColumn("start", F.date_format("start", "yyyy-MM-dd")).fillna(0, ["n", "n_late"])


@query("stream_bars_upsert", "SELECT user_id AS sym, strftime(ts, '%Y-%m-%d %H') AS hour, round(arg_max(value, (ts, event_id)), 8) + 0.0 AS value, count(*) AS n FROM events GROUP BY 1, 2")
def stream_bars_upsert(spark, sf_dir):
    """The last value of each user and hour and the number of events: the source repeats events and brings others late, the run is restarted.

    Repetitions go within the watermark, so counts can be added up; what batches have appended is folded between the two runs, while readers
    may hold older versions.
    """
    path, schema = arriving(spark, sf_dir, "event_id % 3 <> 1", lambda own: own.where("event_id % 3 = 1").unionByName(own.where("event_id % 5 = 0")))
    table, checkpoint = Table(spark, scratch(spark, "upsert")), scratch(spark, "ck")
    keys, latest, seq, added = ["sym", "hour"], ["value"], "seq", ("n",)

    def hourly(batch):
        own = batch.select(F.col("user_id").alias("sym"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "value", F.struct("ts", "event_id").alias("seq"), F.lit(1).cast("long").alias("n"))
        return st.folded(own, keys, latest, seq, added)

    def run():
        unique = st.fresh(st.read_files(spark, path, schema, files=1), ["event_id"], "40 days")
        return st.run_available(unique, checkpoint, sink=st.commit_into(table, "hours", hourly))

    run()
    table.compact(lambda rows: st.folded(rows, keys, latest, seq, added))
    fixtures.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").where("event_id % 7 = 0").coalesce(1).write.mode("append").parquet(path)
    last = run()
    print(f"stream_bars_upsert: {st.state_rows(last)} rows of state, {table.latest()} versions")
    return st.folded(table.read(), keys, latest, seq, added).select("sym", "hour", digits(F.col("value"), 8).alias("value"), "n")


@query("stream_quality_gate", "SELECT CASE WHEN user_id % 5 = 0 THEN 'no symbol' WHEN NOT value > 10 THEN 'bad value' ELSE 'good' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def stream_quality_gate(spark, sf_dir):
    """Events with planted faults: users divisible by five have no symbol, values to 10 count as negative."""
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    path, schema = arriving(spark, sf_dir, "true")
    own = st.read_files(spark, path, schema).select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("sym"), "ts", F.when(F.col("value") > 10, F.col("value")).otherwise(-1.0).alias("value"))
    st.run_available(own, scratch(spark, "ck"), sink=st.gate_into(good, bad))
    schema = "sym long, ts timestamp, value double, reason string"
    kept = spark.read.schema("sym long, ts timestamp, value double").parquet(f"{good}/*").withColumn("reason", F.lit("good"))
    return kept.unionByName(spark.read.schema(schema).parquet(f"{bad}/*")).groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def day_after(last: str):
    """The day that has to follow a committed one."""
    from datetime import date, timedelta

    return date.fromisoformat(last) + timedelta(days=1)


@query("stream_resume", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_id) AS n_distinct, 0 AS n_refused_left FROM events GROUP BY 1")
def stream_resume(spark, sf_dir):
    """Days in order, the stream restarted in the middle; in between a run without checkpoint repeats days and another leaves some out.

    Both are refused with nothing committed, so each event is there once.
    """
    events = fixtures.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").withColumn("day", F.to_date("ts"))
    days = [r.day for r in events.select("day").distinct().orderBy("day").collect()]
    middle, table, checkpoint, source = days[len(days) // 2], Table(spark, scratch(spark, "days")), scratch(spark, "ck"), scratch(spark, "src")
    sink = st.commit_into(table, "days", order="day", next_of=day_after)
    refused = 0

    def run(path, ck):
        st.run_available(st.read_files(spark, path, events.schema), ck, sink=sink)

    events.where(F.col("day") < middle).write.parquet(source)
    run(source, checkpoint)
    for wrong in (events.where(F.col("day") < middle), events.where(F.col("day") > middle)):
        other, before = scratch(spark, "src"), table.latest()
        wrong.write.parquet(other)
        try:
            run(other, scratch(spark, "ck"))
        except Exception as e:
            if "Refused" not in str(e):
                raise
            refused += table.latest() == before
    events.where(F.col("day") >= middle).write.mode("append").parquet(source)
    run(source, checkpoint)
    return table.read().groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct"), F.lit(2 - refused).alias("n_refused_left"))

"""The state of bars is handled in rows: a table a key costs more than its events."""

from panelforge.sources.shared import scratch
from panelforge.streaming import bars as st


def test_bars_of_a_missing_value_and_rows_instead_of_tables(spark):
    path, schema = scratch(spark, "events"), "ts timestamp, user_id long, event_id long, value double"
    own = spark.sql("SELECT timestamp'2024-01-01 08:00:00' + make_interval(0, 0, 0, 0, id) AS ts, id % 2 AS user_id, id AS event_id, CASE id WHEN 0 THEN double('NaN') WHEN 1 THEN NULL ELSE double(id) END AS value FROM range(6)")
    own.coalesce(1).write.parquet(path)
    made = st.bars_from_events(st.read_files(spark, path, schema))
    assert "InPandas" not in made._jdf.queryExecution().analyzed().toString()
    spark.sql("SELECT timestamp'2024-02-01 00:00:00' AS ts, -1L AS user_id, -1L AS event_id, 0D AS value").coalesce(1).write.mode("append").parquet(path)
    out, check = scratch(spark, "bars"), scratch(spark, "ck")
    st.run_available(made, check, path=out)
    got = {r.sym: (r.open, r.high, r.low, r.close, r.n) for r in spark.read.parquet(out).where("kind = 'bar' and sym >= 0").collect()}
    assert got == {0: (None, 4.0, 2.0, 4.0, 3), 1: (None, 5.0, 3.0, 5.0, 3)}

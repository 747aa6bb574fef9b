"""Point-in-time universe: session axis, dense panel, membership by interval join, reasons and eligibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
#: Reason bits. All but STATUS_UNKNOWN block.
NOT_MEMBER, NOT_YET_LISTED, AGE_INSUFFICIENT, STATUS_UNKNOWN, MISSING_BAR = 1, 2, 4, 8, 16
BLOCKING = NOT_MEMBER | NOT_YET_LISTED | AGE_INSUFFICIENT | MISSING_BAR


def session_axis(calendar: DataFrame) -> DataFrame:
    """``dt, sess``: distinct open sessions, numbered from 0. A calendar is small, so one ordered window is enough."""
    return calendar.where("is_open and dt is not null").select("dt").distinct().withColumn("sess", F.row_number().over(Window.orderBy("dt")) - 1)


def dense_panel(symbols: DataFrame, bars: DataFrame, axis: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """One row per symbol and session between the first and the last bar; a missing bar stays NULL.

    The axis is small and broadcast. A symbol's bar makes the cells up to the next one (the first those before it too), so cells are neither
    shuffled nor joined to bars: bars that are dealt by symbol stay where they are. ``edge`` (``first, last``, one row) spares finding the
    first and the last bar where they are known.
    """
    edge = bars.agg(F.min("dt").alias("first"), F.max("dt").alias("last")) if edge is None else edge
    inside = axis.join(F.broadcast(edge), F.col("dt").between(F.col("first"), F.col("last"))).select("dt", F.row_number().over(Window.orderBy("dt")).alias("n")).select("dt", (F.col("n") - 1).alias("sess"))
    end = F.broadcast(inside.agg((F.count("dt") - 1).cast("int").alias("_end"))).where("_end >= 0")
    values = [k for k in bars.columns if k not in ("sym", "dt")]
    placed = bars.join(F.broadcast(inside.withColumnRenamed("sess", "_at")), "dt").select("sym", "_at", *values)
    own = symbols.select("sym").distinct().join(placed, "sym", "left").crossJoin(end)
    w = Window.partitionBy("sym").orderBy("_at")
    own = own.withColumns({"_from": F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("_at")), "_next": F.lead("_at").over(w)})
    cells = own.withColumn("sess", F.explode(F.sequence("_from", F.greatest("_at", F.coalesce(F.col("_next") - 1, "_end")))))
    cells = cells.select("sym", "sess", *(F.when(F.col("sess") == F.col("_at"), F.col(k)).alias(k) for k in values))
    return cells.join(F.broadcast(inside), "sess").select("sym", "dt", "sess", *values)


def inclusive_end(out_date: Column) -> Column:
    """Inclusive to half-open; open ends stay."""
    return F.when(out_date == F.lit(OPEN_END).cast("date"), out_date).otherwise(F.date_add(out_date, 1))


def coalesced(intervals: DataFrame) -> DataFrame:
    """``sym, in_date, out_date``: the dates that any interval [in_date, out_date) of a symbol covers, as intervals that neither meet
    nor overlap. A sweep by start: an island begins where an interval starts past the end of all before it.

    Intervals with a missing end or none of a length cover nothing.
    """
    w = Window.partitionBy("sym").orderBy("in_date", "out_date")
    apart = F.coalesce(F.col("in_date") > F.max("out_date").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    own = intervals.where("in_date < out_date").select("sym", "in_date", "out_date").withColumn("_apart", apart.cast("int"))
    own = own.withColumn("_island", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("sym", "_island").agg(F.min("in_date").alias("in_date"), F.max("out_date").alias("out_date")).drop("_island")


def with_membership(cells: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """``cells`` with ``name``: whether ``dt`` is inside any interval of ``sym``. A cell meets one coalesced interval at most, so rows
    neither multiply nor have to be made distinct; the join is keyed on ``sym``."""
    i = coalesced(intervals).select(F.col("sym").alias("_sym"), F.col("in_date").alias("_in"), F.col("out_date").alias("_out"))
    inside = (F.col("sym") == F.col("_sym")) & (F.col("dt") >= F.col("_in")) & (F.col("dt") < F.col("_out"))
    return cells.join(i, inside, "left").withColumn(name, F.col("_sym").isNotNull()).drop("_sym", "_in", "_out")


def members_at(cells: DataFrame, intervals: DataFrame) -> DataFrame:
    """``sym, dt`` of ``cells`` inside any interval [in_date, out_date)."""
    return with_membership(cells.select("sym", "dt"), intervals, "_member").where("_member").drop("_member")


def first_at_or_after(rows: DataFrame, axis: DataFrame, date: str) -> DataFrame:
    """``rows`` with ``idx``, the first session not before ``date``, or the number of sessions; NULL for no date.

    Each calendar day between the first and the last session is one row of a lookup table (some 250 to 365 a year, whatever the data
    hold), which is sent whole and hashed: a row costs one probe, not a walk along the calendar.
    """
    w = Window.orderBy("dt")
    open_days = axis.select("dt", (F.row_number().over(w) - 1).cast("int").alias("_idx"), F.lag("dt").over(w).alias("_before"))
    days = open_days.select(F.explode(F.sequence(F.coalesce(F.date_add("_before", 1), "dt"), F.col("dt"))).alias("_day"), "_idx")
    edge = axis.agg(F.min("dt").alias("_from"), F.count("dt").cast("int").alias("_n"))
    own = rows.join(F.broadcast(days), F.col(date) == F.col("_day"), "left").crossJoin(F.broadcast(edge))
    place = F.when(F.col(date) < F.col("_from"), 0).otherwise(F.coalesce("_idx", "_n"))
    return own.withColumn("idx", F.when(F.col(date).isNotNull(), place)).drop("_day", "_idx", "_from", "_n")


def listing_age(cells: DataFrame, stocks: DataFrame, axis: DataFrame) -> DataFrame:
    """``cells`` with ``list_date`` and ``age``: sessions since listing, the first counts 1, below 1 before it; NULL if it is past the axis."""
    first = first_at_or_after(stocks.select("sym", "list_date").dropDuplicates(["sym"]), axis, "list_date")
    end = F.broadcast(axis.agg(F.count("dt").alias("_n")))
    first = first.crossJoin(end).select("sym", "list_date", F.when(F.col("idx") < F.col("_n"), F.col("idx")).alias("_first"))
    return cells.join(first, "sym", "left").withColumn("age", F.col("sess") - F.col("_first") + 1).drop("_first")


def reasons(panel: DataFrame, stocks: DataFrame, intervals: DataFrame, axis: DataFrame, min_listed: int) -> DataFrame:
    """``panel`` with ``reasons`` (bits) and ``elig``."""
    own = with_membership(listing_age(panel, stocks, axis), intervals, "_member")
    bit = lambda cond, value: F.when(cond, value).otherwise(0)
    before = F.coalesce(F.col("dt") < F.col("list_date"), F.lit(False))
    parts = [bit(~F.col("_member"), NOT_MEMBER), bit(before, NOT_YET_LISTED), bit(~before & (F.coalesce("age", F.lit(0)) < min_listed), AGE_INSUFFICIENT), F.lit(STATUS_UNKNOWN), bit(F.col("close").isNull(), MISSING_BAR)]
    own = own.withColumn("reasons", reduce(lambda a, b: a.bitwiseOR(b), parts).cast("int"))
    return own.withColumn("elig", F.col("reasons").bitwiseAND(BLOCKING) == 0).drop("_member")


def reason_histogram(panel: DataFrame) -> DataFrame:
    named = {"not_member": NOT_MEMBER, "not_yet_listed": NOT_YET_LISTED, "age_insufficient": AGE_INSUFFICIENT, "status_unknown": STATUS_UNKNOWN, "missing_bar": MISSING_BAR}
    return panel.groupBy("dt").agg(*(F.count(F.when(F.col("reasons").bitwiseAND(b) != 0, 1)).alias(k) for k, b in named.items()), F.count(F.when(F.col("elig"), 1)).alias("eligible"))


def marked_intervals(intervals: DataFrame) -> DataFrame:
    """``intervals`` with ``issue``: blank, empty, overlap or NULL."""
    blank = F.col("index_code").isNull() | F.col("sym").isNull() | F.col("in_date").isNull() | F.col("out_date").isNull()
    before = Window.partitionBy("index_code", "sym").orderBy("in_date", "out_date").rowsBetween(Window.unboundedPreceding, -1)
    marked = intervals.withColumn("_last", F.max("out_date").over(before))
    issue = F.when(blank, "blank").when(F.col("out_date") <= F.col("in_date"), "empty").when(F.col("in_date") < F.col("_last"), "overlap")
    return marked.withColumn("issue", issue).drop("_last")


def interval_issues(intervals: DataFrame) -> DataFrame:
    """Structural errors, one row each: ``issue, index_code, sym, in_date``; empty if the table is sound."""
    return marked_intervals(intervals).where("issue is not null").select("issue", "index_code", "sym", "in_date")


#: What untyped tables have to hold.
INTERVAL_FIELDS, CALENDAR_FIELDS = ("index_code", "sym", "in_date", "out_date"), ("dt", "is_open")
REPORT = "issue string, field string, index_code string, sym string, in_date string, out_date string"


def as_date(x: Column) -> Column:
    """The date that a date, a time, a number or text writes as yyyyMMdd or yyyy-MM-dd; NULL for anything else, never an error."""
    text = F.trim(x.cast("string"))
    plain = F.when(text.rlike(r"^\d{8}$"), text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}( 00:00:00)?$"), F.regexp_replace(F.substring(text, 1, 10), "-", ""))
    return F.try_to_timestamp(plain, F.lit("yyyyMMdd")).cast("date")


def missing_fields(df: DataFrame, fields: tuple[str, ...], schema: str) -> DataFrame | None:
    """A row for each field that ``df`` lacks; None if it has all."""
    absent = [f for f in fields if f not in df.columns]
    width = len(schema.split(","))
    return df.sparkSession.createDataFrame([("missing column", f, *[None] * (width - 2)) for f in absent], schema) if absent else None


def interval_report(raw: DataFrame) -> DataFrame:
    """Every error of an untyped table of intervals, one row each: ``issue, field, index_code, sym, in_date, out_date`` (as text).

    ``missing column`` (then nothing else can be said), ``no rows``, ``blank`` (missing or only spaces), ``invalid date``; rows without
    these are read as typed and checked for ``empty`` (not ending after their start) and ``overlap`` (starting before the end of an
    earlier one of the same index and symbol; repeated rows overlap). Other columns are ignored. It never raises.
    """
    if (absent := missing_fields(raw, INTERVAL_FIELDS, REPORT)) is not None:
        return absent
    texts = raw.select(*(F.trim(F.col(f).cast("string")).alias(f) for f in INTERVAL_FIELDS))
    blank = lambda f: F.coalesce(F.col(f) == "", F.lit(True))
    faults = [F.when(blank(f), F.struct(F.lit("blank").alias("issue"), F.lit(f).alias("field"))) for f in INTERVAL_FIELDS]
    faults += [F.when(~blank(f) & as_date(F.col(f)).isNull(), F.struct(F.lit("invalid date").alias("issue"), F.lit(f).alias("field"))) for f in ("in_date", "out_date")]
    seen = texts.withColumn("_faults", F.array_compact(F.array(*faults)))
    single = seen.select(F.explode("_faults").alias("_f"), *INTERVAL_FIELDS).select("_f.issue", "_f.field", *INTERVAL_FIELDS)
    typed = seen.where(F.size("_faults") == 0).select("index_code", "sym", as_date(F.col("in_date")).alias("in_date"), as_date(F.col("out_date")).alias("out_date"))
    iso = lambda f: F.date_format(f, "yyyy-MM-dd").alias(f)
    bad = marked_intervals(typed).where("issue is not null").select("issue", F.lit("in_date").alias("field"), "index_code", "sym", iso("in_date"), iso("out_date"))
    none = texts.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit("no rows").alias("issue"), *(F.lit(None).cast("string").alias(f) for f in ("field", *INTERVAL_FIELDS)))
    return single.unionByName(bad).unionByName(none)


def calendar_report(raw: DataFrame) -> DataFrame:
    """Every error of an untyped calendar, one row each: ``issue, field, dt`` (as text): ``missing column``, ``invalid date`` of a row
    that is open (missing counts as closed; text and numbers as true and 1), ``no open session`` if no valid one is left. Never raises."""
    schema = "issue string, field string, dt string"
    if (absent := missing_fields(raw, CALENDAR_FIELDS, schema)) is not None:
        return absent
    opened = open_rows(raw)
    bad = opened.where("_date is null").select(F.lit("invalid date").alias("issue"), F.lit("dt").alias("field"), "dt")
    none = opened.agg(F.count("_date").alias("_n")).where("_n = 0").select(F.lit("no open session").alias("issue"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("dt"))
    return bad.unionByName(none)


def open_rows(raw: DataFrame) -> DataFrame:
    flag = F.lower(F.trim(F.col("is_open").cast("string"))).isin("true", "1", "1.0")
    return raw.where(F.coalesce(flag, F.lit(False))).select(F.col("dt").cast("string").alias("dt"), as_date(F.col("dt")).alias("_date"))


def session_axis_from(raw: DataFrame) -> DataFrame:
    """:func:`session_axis` of an untyped calendar; what :func:`calendar_report` names has no part in it."""
    return session_axis(open_rows(raw).select(F.col("_date").alias("dt"), F.lit(True).alias("is_open")))


def snapshot_shaped(intervals: DataFrame, axis: DataFrame) -> DataFrame:
    """One row: whether the table is one current snapshot stretched over history."""
    first = axis.agg(F.min("dt").alias("first"))
    own = intervals.agg(F.count_distinct("in_date").alias("n_in"), F.count_distinct("out_date").alias("n_out"), F.min("in_date").alias("in_date"), F.min("out_date").alias("out_date"))
    return own.crossJoin(first).select(((F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("out_date") == F.lit(OPEN_END).cast("date")) & (F.col("in_date") <= F.col("first"))).alias("snapshot_shaped"))


def universe_gate(intervals: DataFrame, stocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """What keeps the universe from use, as rows ``issue, item``: the caller raises if there are any."""
    text = lambda c: F.col(c).cast("string").alias("item")
    absent = wanted.join(intervals, "index_code", "left_anti").select(F.lit("index absent").alias("issue"), text("index_code"))
    stray = intervals.join(stocks, "sym", "left_anti").select(F.lit("member not in stocks").alias("issue"), text("sym")).distinct()
    dateless = stocks.join(intervals, "sym", "left_semi").where("list_date is null").select(F.lit("list date missing").alias("issue"), text("sym"))
    early = intervals.join(stocks.select("sym", "list_date"), "sym").where("in_date < list_date").select(F.lit("interval before listing").alias("issue"), text("sym")).distinct()
    broken = interval_issues(intervals).select(F.concat(F.lit("interval "), "issue").alias("issue"), text("sym"))
    return absent.unionByName(stray).unionByName(dateless).unionByName(early).unionByName(broken)


def whole_period_members(stocks: DataFrame, axis: DataFrame) -> DataFrame:
    """Explicit fall-back: every stock a member from the first session on, with open end."""
    return stocks.select("sym").distinct().crossJoin(F.broadcast(axis.agg(F.min("dt").alias("in_date")))).select(F.lit("ALL").alias("index_code"), "sym", "in_date", F.lit(OPEN_END).cast("date").alias("out_date"))


def masked(value: str, elig: str = "elig") -> Column:
    return F.when(F.col(elig), F.col(value))

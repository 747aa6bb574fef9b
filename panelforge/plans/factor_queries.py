"""One query per factor, over the daily panel: its calendar is longer than the longest window."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import factors as lib
from panelforge.functions.numeric import digits
from panelforge.operators import panel
from panelforge.plans import base_sql as b
from panelforge.plans.registry import query


def _enter(name: str) -> None:
    @query(f"factor_{name}", b.by_day(b.factor_sql(name)) if name in b.FACTORS or name in b.EWM_NAMES else None)
    def run(spark, sf_dir):
        made = lib.factors(panel.standard(spark, sf_dir, daily=True), [name])
        return made.select("sym", "dt", digits(F.col(name).cast("double"), b.PLACES.get(name, 6)).alias("value"))


for _name in lib.REGISTRY:
    if not any(x.startswith("ext_") for x in lib.REGISTRY[_name].needs):
        _enter(_name)

#: Sessions that count as new in the queries on appended sessions.
NEW = 20
WHOLE = [n for n, x in b.FACTORS.items() if not x.lstrip().startswith("SELECT")]


def first_new(cells) -> int:
    """The first of the last ``NEW`` sessions, one number."""
    return (cells.agg(F.max("sess")).first()[0] or 0) - NEW + 1


@query(
    "factor_increment",
    b.by_day(
        f"""WITH {b.HELPERS}, made AS (SELECT sym, dt, sess, {', '.join(f'CAST({b.FACTORS[n]} AS DOUBLE) AS {n}' for n in WHOLE)} FROM h)
        SELECT sym, dt::VARCHAR AS dt, {', '.join(f'{b.fixed(n, b.PLACES.get(n, 6))} AS {n}' for n in WHOLE)} FROM made WHERE sess > (SELECT max(sess) FROM axis) - {NEW}"""
    ),
)
def factor_increment(spark, sf_dir):
    """The last sessions' factors from those sessions and the warm-up before them."""
    cells = panel.standard(spark, sf_dir, daily=True)
    made = lib.appended(cells, WHOLE, first_new(cells))
    return made.select("sym", "dt", *(digits(F.col(n).cast("double"), b.PLACES.get(n, 6)).alias(n) for n in WHOLE))

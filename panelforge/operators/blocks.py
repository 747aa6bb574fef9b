"""Blocks of a wide panel's values by session: what is shuffled where a figure needs all of a session's values of a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it cuts them into blocks.
ROWS = 65_536


def packed(wide: DataFrame, groups: list[list[str]]) -> DataFrame:
    """``sess, part, block``: for each session and list of columns their values, row by row as doubles (NULL: NaN)."""
    import numpy as np
    import pandas as pd

    names = list(dict.fromkeys(c for g in groups for c in g))
    place = [[names.index(c) for c in g] for g in groups]

    def cut(held):
        rows = pd.concat(held)
        order = np.argsort(rows["sess"].to_numpy(), kind="stable")
        days, first = np.unique(rows["sess"].to_numpy()[order], return_index=True)
        values = np.split(rows[names].to_numpy(np.float64)[order], first[1:])
        own = [(d, k, np.ascontiguousarray(v[:, p]).tobytes()) for d, v in zip(days, values, strict=True) for k, p in enumerate(place)]
        return pd.DataFrame(own, columns=["sess", "part", "block"])

    def run(parts):
        held, n = [], 0
        for p in parts:
            held.append(p)
            n += len(p)
            if n >= ROWS:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    return wide.select("sess", *(F.col(c).cast("double").alias(c) for c in names)).mapInPandas(run, "sess int, part int, block binary")


def unpacked(keys, rows, groups: list[list[str]]):
    """The columns of a group of blocks and their values, a row a cell."""
    import numpy as np

    group = groups[keys[1].as_py()]
    return group, np.frombuffer(b"".join(rows.column("block").to_pylist())).reshape(-1, len(group))

"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys with more rows than this, and than a thousandth of all, are joined by a broadcast of under 1,000 rows.
FREQUENT_ROWS = 10_000


def join_by_key(rows: DataFrame, unique: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key, whose column ``n`` counts the key's rows.

    ``total`` is the number of ``rows``. As every frequent key has over a
    thousandth of them, there are less than a thousand such keys, whatever the
    table; the others meet by a shuffle in which no key has more rows than that.
    """
    most = max(FREQUENT_ROWS, total // 1000)
    if total <= most:
        return rows.join(unique.drop(n), key)
    frequent = F.broadcast(unique.where(F.col(n) > most).drop(n))
    seldom = rows.join(frequent.select(key), key, "left_anti").join(unique.where(F.col(n) <= most).drop(n), key)
    return seldom.unionByName(rows.join(frequent, key))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

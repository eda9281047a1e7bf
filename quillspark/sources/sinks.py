"""Ordered tables, columnar JSON, and files for coders."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import fragment, has_email
from quillspark.sources.http import filesystem

#: Rows of published aggregates, and of a printed table, that may come to the driver.
MOST_PUBLISHED, MOST_PRINTED = 1_000_000, 1_000


def few_rows(df: DataFrame, most: int, what: str) -> list:
    """All rows of a small table; an error, before more than ``most`` of them leave the executors, for a larger one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} takes up to {most} rows; aggregate or select first")
    return rows


def total_order(df: DataFrame, keys: list[str]) -> list[Column]:
    """The keys, then every other column in schema order, nulls last: no ties are left to chance."""
    rest = [c for c in df.columns if c not in keys]
    sortable = [c for c in keys + rest if df.schema[c].dataType.typeName() not in ("map", "variant")]
    return [F.col(c).asc_nulls_last() for c in sortable]


def write_table(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """Parquet in total order, zstd; Spark's committer makes the write atomic. ``files=1`` for small tables of stable bytes."""
    ordered = df.orderBy(*total_order(df, keys))
    (ordered.coalesce(files) if files else ordered).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_fragments(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """One folder for each hash fragment of the key, so a reader that has the key opens one of them."""
    df.withColumn("fragment", fragment(F.col(key), buckets)).repartition("fragment").write.mode("overwrite").partitionBy("fragment").json(path)


def columnar(df: DataFrame, keys: list[str], dictionaries: list[str] = ()) -> dict:
    """Column lists of a published (small) table; dictionary columns hold positions by falling count, -1 for null."""
    rows = few_rows(df.orderBy(*total_order(df, keys)), MOST_PUBLISHED, "columnar JSON")
    out: dict = {"columns": {c: [r[c] for r in rows] for c in df.columns}, "dictionaries": {}}
    for c in dictionaries:
        values = out["columns"][c]
        times = Counter(v for v in values if v is not None)
        names = sorted(times, key=lambda v: (-times[v], v))
        place = {v: i for i, v in enumerate(names)}
        out["dictionaries"][c] = names
        out["columns"][c] = [place.get(v, -1) for v in values]
    return out


def write_contract(tables: dict[str, dict], folder: str) -> None:
    """One JSON file a table, the manifest last, so a reader that finds it finds everything."""
    system, where = filesystem(folder)
    system.create_dir(where)
    for name, table in [*tables.items(), ("manifest", {"tables": sorted(tables)})]:
        with system.open_output_stream(f"{where}/{name}.json") as f:
            f.write(json.dumps(table, ensure_ascii=False, sort_keys=True).encode())


def publishable(df: DataFrame, licence: str, columns: list[str]) -> DataFrame:
    """Columns that only open licences allow to publish become null for others."""
    return df.withColumns({c: F.when(F.col(licence).like("cc%"), F.col(c)) for c in columns})


def private_rows(df: DataFrame, columns: list[str]) -> int:
    """Rows with an address of any form in any of the columns, by the detector that cleans them; a release needs 0."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(has_email(c), F.lit(False))
    return df.where(hit).count()


def materialise(df: DataFrame, form: str = "dicts"):
    """Rows as dicts, tuples, a pandas frame or an Arrow table."""
    forms = {"dicts": lambda: [r.asDict(True) for r in df.collect()], "tuples": lambda: [tuple(r) for r in df.collect()], "pandas": df.toPandas, "arrow": df.toArrow}
    if form not in forms:
        raise ValueError(f"form is one of {', '.join(forms)}")
    return forms[form]()


def markdown(df: DataFrame, caption: str = "") -> str:
    """A small table as Markdown, whole or not at all."""
    rows = few_rows(df, MOST_PRINTED, "a printed table")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    body = ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(([caption, ""] if caption else []) + head + body)


def latex(df: DataFrame) -> str:
    rows = few_rows(df, MOST_PRINTED, "a printed table")
    escape = lambda v: "" if v is None else str(v).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%")
    body = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"])


def write_lines(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines in total order, for coders and supervisors."""
    df.orderBy(*total_order(df, keys)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV with a header, the data of a figure."""
    df.orderBy(*total_order(df, keys)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

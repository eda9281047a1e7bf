"""Cross-filtered aggregation: one bit for each failed dimension, each view ignoring its own."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed order of the dimensions; a dimension's bit is two to the power of its place.
DIMENSIONS = ("year", "journal", "topic", "search", "lasso", "state", "country", "institution")


@dataclass
class Filters:
    """What each dimension is restricted to; an empty list restricts nothing."""

    years: tuple[int, int] | None = None
    values: dict[str, list] = field(default_factory=dict)

    def canonical(self) -> Filters:
        """Years in order, values distinct and sorted, unknown and empty dimensions left out."""
        years = (min(self.years), max(self.years)) if self.years else None
        return Filters(years, {k: sorted(set(v)) for k, v in sorted(self.values.items()) if k in DIMENSIONS and v})

    def encode(self) -> str:
        """Query string of the canonical filters."""
        own = self.canonical()
        parts = [f"years={own.years[0]}-{own.years[1]}"] if own.years else []
        return "&".join(parts + [f"{k}={quote(json.dumps(v, ensure_ascii=False), safe='')}" for k, v in own.values.items()])

    @classmethod
    def decode(cls, text: str) -> Filters:
        """The filters of a query string; parts that make no sense are dropped."""
        years, values = None, {}
        for key, value in parse_qsl(text):
            try:
                if key == "years":
                    lo, _, hi = value.partition("-")
                    years = (int(lo), int(hi or lo))
                elif key in DIMENSIONS and isinstance(found := json.loads(value), list):
                    values[key] = found
            except ValueError:
                continue
        return cls(years, values).canonical()


def failures(df: DataFrame, tests: dict[str, Column], column: str = "failures") -> DataFrame:
    """Add the bit sum of the dimensions whose test a row does not pass; a null result fails."""
    bits = [F.when(F.coalesce(t, F.lit(False)), 0).otherwise(1 << DIMENSIONS.index(d)) for d, t in tests.items()]
    total = F.lit(0)
    for b in bits:
        total = total + b
    return df.withColumn(column, total)


def passing(df: DataFrame, besides: str | None = None, column: str = "failures") -> DataFrame:
    """Rows that fail no dimension, the one named aside."""
    keep = ~(1 << DIMENSIONS.index(besides)) if besides else ~0
    return df.where(F.col(column).bitwiseAND(F.lit(keep)) == 0)


def counts_without_own(df: DataFrame, views: dict[str, str], column: str = "failures") -> DataFrame:
    """(dimension, value, n): each view counted with its own dimension ignored, in one pass over the rows."""
    cells = [
        F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value"))
        for d, c in views.items()
    ]
    kept = [F.when((F.col(column).bitwiseAND(F.lit(~(1 << DIMENSIONS.index(d)))) == 0) & F.col(views[d]).isNotNull(), cell) for d, cell in zip(views, cells, strict=True)]
    return df.select(F.explode(F.array_compact(F.array(*kept))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def inside(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule with the last corner joined to the first; fewer than three corners hold nothing.

    The bounding box comes first: it reaches the scan as a filter on plain columns.
    """
    if len(polygon) < 3:
        return F.lit(False)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            at = F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
            crossings = crossings + F.when(((y < y1) != (y < y2)) & (x < at), 1).otherwise(0)
    return box & (crossings % 2 == 1)


def simplify(line: list[tuple[float, float]], most: int = 30) -> list[tuple[float, float]]:
    """A polygon of at most ``most`` corners by dropping corners near the line between their neighbours kept."""

    def thin(tolerance: float) -> list[tuple[float, float]]:
        keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
        while stack:
            a, b = stack.pop()
            (x1, y1), (x2, y2) = line[a], line[b]
            length = math.hypot(x2 - x1, y2 - y1)
            best, at = 0.0, None
            for i in range(a + 1, b):
                x, y = line[i]
                d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else math.hypot(x - x1, y - y1)
                if d > best:
                    best, at = d, i
            if at is not None and best > tolerance:
                keep.add(at)
                stack += [(a, at), (at, b)]
        return [line[i] for i in sorted(keep)]

    if len(line) <= most:
        return list(line)
    tolerance = max(max(p[i] for p in line) - min(p[i] for p in line) for i in (0, 1)) / 1000 or 1e-9
    while len(out := thin(tolerance)) > most:
        tolerance *= 1.5
    return out


def at_any_place(docs: DataFrame, places: DataFrame, key: str, test: Column) -> DataFrame:
    """Documents with at least one place that passes."""
    return docs.join(places.where(test).select(key), key, "left_semi")


def both_ends(edges: DataFrame, selection: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Edges whose two ends are selected."""
    s = selection.select(F.col(key).alias("_s")).distinct()
    return edges.join(s, F.col(a) == F.col("_s"), "left_semi").join(s, F.col(b) == F.col("_s"), "left_semi")


def log_breaks(most: float, steps: tuple[int, ...] = (1, 2, 5)) -> list[float]:
    """Round class limits up to ``most``: 1, 2, 5, 10, 20, ..."""
    out, power = [], 0
    while True:
        for s in steps:
            value = float(s * 10**power)
            if value > most:
                return out or [1.0]
            out.append(value)
        power += 1


def class_of(value: Column, breaks: list[float]) -> Column:
    """How many limits a value reaches."""
    total = F.lit(0)
    for b in breaks:
        total = total + F.when(value >= b, 1).otherwise(0)
    return F.when(value.isNotNull(), total)


def affine(value: Column, low: float, high: float) -> Column:
    """Map low..high to -1..1; a single point goes to 0."""
    return F.lit(0.0) if high == low else (value - low) / (high - low) * 2 - 1


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    accented = "áàâãäåçéèêëíìîïñóòôõöøúùûüýÿ"
    return F.translate(F.lower(text), accented, "aaaaaaceeeeiiiinoooooouuuuyy")


def search(docs: DataFrame, query: str, key: str, fields: dict[str, float], fuzzy: float = 0.2) -> DataFrame:
    """(key, score): documents in which every word of the query starts, or nearly is, some word.

    Words over four letters also match within a fifth of their length in edits;
    a field's weight counts once for each matching query word.
    """
    words = sorted({w for w in folded_text(query).split() if w})
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = None
    for name, weight in fields.items():
        part = docs.select(key, F.lit(weight).alias("weight"), F.explode(F.array_distinct(F.split(folded(F.col(name)), r"[^\p{L}\p{N}]+"))).alias("token")).where("token <> ''")
        tokens = part if tokens is None else tokens.unionByName(part)
    hits = None
    for w in words:
        near = F.col("token").startswith(w)
        if len(w) > 4:
            near = near | ((F.abs(F.length("token") - len(w)) <= math.ceil(fuzzy * len(w))) & (F.levenshtein("token", F.lit(w)) <= math.ceil(fuzzy * len(w))))
        part = tokens.where(near).select(key, F.lit(w).alias("word"), "weight")
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy(key, "word").agg(F.max("weight").alias("weight"))
    return best.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("score")).where(F.col("n") == len(words)).select(key, "score")


def folded_text(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))

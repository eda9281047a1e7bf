"""Agreement between raters, intervals, tests and partition indices."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how often each pair of answers occurs; rows with a missing answer take no part."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def agreement(pairs: DataFrame, a: str, b: str, categories: int | None = None) -> DataFrame:
    """One row: n, observed agreement, Cohen's kappa and PABAK.

    Kappa is null when agreement is certain by chance, or without rows. PABAK
    takes the number of categories, or counts those seen.
    """
    counts = confusion(pairs, a, b)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("na"))
    right = counts.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    both = left.join(right, "v", "full_outer").agg(F.sum(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0))).alias("chance"), F.count(F.lit(1)).alias("seen"))
    row = total.crossJoin(both)  # two single rows
    n = F.col("n").cast("double")
    po, pe = F.try_divide(F.col("same"), n), F.try_divide(F.col("chance"), n * n)
    k = F.lit(categories).cast("long") if categories else F.col("seen")
    return row.select(
        F.coalesce("n", F.lit(0)).alias("n"),
        po.alias("observed"),
        F.when(F.col("chance") == F.col("n") * F.col("n"), None).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"),
        F.try_divide(k * po - 1, k - 1).alias("pabak"),
    )


def krippendorff_alpha(answers: DataFrame, unit: str, value: str) -> DataFrame:
    """One row (alpha): nominal alpha with missing answers; units with one answer are ignored, no variation gives null."""
    counts = answers.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("c"))
    units = counts.groupBy(unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares")).where("m > 1")
    pairable = counts.join(units.select(unit, "m"), unit)
    marginals = pairable.groupBy(value).agg(F.sum("c").alias("n"))
    disagree = units.agg(F.sum((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("observed"))
    expected = marginals.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    n, apart = F.col("n"), F.col("n") * F.col("n") - F.col("squares")
    return disagree.crossJoin(expected).select((1 - F.try_divide((n - 1) * F.col("observed"), F.when(apart != 0, apart))).alias("alpha"))


def per_class(pairs: DataFrame, reference: str, other: str) -> DataFrame:
    """(class, precision, recall, f1, n): each class of either rater; a share of nothing is null, F1 is not."""
    counts = confusion(pairs, reference, other)
    classes = counts.select(F.explode(F.array(reference, other)).alias("class")).distinct()
    stats = classes.join(counts, (F.col("class") == F.col(reference)) | (F.col("class") == F.col(other))).groupBy("class").agg(
        F.sum(F.when((F.col(reference) == F.col("class")) & (F.col(other) == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(other) == F.col("class"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col(reference) == F.col("class"), F.col("n")).otherwise(0)).alias("n"),
    )
    p, r = F.try_divide("tp", F.col("said")), F.try_divide("tp", F.col("n"))
    return stats.select("class", p.alias("precision"), r.alias("recall"), (2.0 * F.col("tp") / (F.col("said") + F.col("n"))).alias("f1"), "n")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Struct (low, high): Wilson interval of a share, null for n = 0."""
    p = F.try_divide(hits.cast("double"), n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def differ(k1: Column, n1: Column, k2: Column, n2: Column, z: float = 1.959963984540054) -> Column:
    """Whether two shares differ by the pooled two-proportion z test at 5 %; false where undefined."""
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.coalesce(F.when((n1 > 0) & (n2 > 0) & (se > 0), F.abs(k1 / n1 - k2 / n2) > z * se), F.lit(False))


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p of b against c discordant pairs; 1 without any, 0 below about 1e-300.

    Binomial weights follow from each other by their ratios, from the middle
    down to where a float ends, and are divided by their sum. That is about 19
    times the square root of the pairs in steps, whatever b and c are.
    """
    n, k = b + c, min(b, c)
    middle, weight, weights = n // 2, 1.0, []
    for i in range(middle, -1, -1):
        weights.append(weight)
        weight *= i / (n - i + 1)
        if weight < sys.float_info.min:  # a denormal weight would stop shrinking
            break
    total = 2 * math.fsum(weights) - (0 if n % 2 else 1)  # an even number has one middle weight, an odd one two
    return min(1.0, 2 * math.fsum(weights[middle - k :]) / total)


def mcnemar(pairs: DataFrame, reference: str, first: str, second: str) -> DataFrame:
    """One row: pairs that only one of two raters has right, and the exact p."""
    right1, right2 = F.col(first) == F.col(reference), F.col(second) == F.col(reference)
    counts = pairs.agg(F.count_if(right1 & ~right2).alias("only_first"), F.count_if(~right1 & right2).alias("only_second"))

    @F.pandas_udf("double")
    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_exact(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")

    return counts.withColumn("p", p("only_first", "only_second"))


def kappa_of(a: np.ndarray, b: np.ndarray) -> float | None:
    if not len(a):
        return None
    pe = sum((a == v).mean() * (b == v).mean() for v in np.union1d(a, b))
    return None if pe >= 1 else float(((a == b).mean() - pe) / (1 - pe))


def kappa_interval(pairs: DataFrame, a: str, b: str, order: str, keys: list[str] | None = None, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, low, high): percentile bootstrap of kappa; null below 10 rows or where over half of the draws are undefined.

    Rows are put into ``order`` before they are drawn, so the interval does not
    depend on partitions. Samples of coded documents are hundreds of rows.
    """
    keys = keys or []
    own = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(order).alias("_order"), F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order", kind="stable")
        x, y, low, high = pdf["_a"].to_numpy(str), pdf["_b"].to_numpy(str), None, None
        if len(x) >= 10:
            rng = np.random.default_rng(seed)
            draws = [kappa_of(x[i], y[i]) for i in (rng.integers(0, len(x), len(x)) for _ in range(resamples))]
            defined = [k for k in draws if k is not None]
            if 2 * len(defined) >= resamples:
                low, high = (float(q) for q in np.percentile(defined, [2.5, 97.5]))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "low": low, "high": high}])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.select(*keys).schema) + "low double, high double"
    return own.groupBy(*keys).applyInPandas(interval, schema)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari): adjusted Rand index of two labelings of the same rows."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    counts = confusion(labels, a, b)
    cells = counts.agg(F.sum(two("n")).alias("cells"), F.sum("n").alias("total"))
    rows = counts.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("rows"))
    columns = counts.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("columns"))
    everything = cells.crossJoin(rows).crossJoin(columns)  # single rows
    expected = F.col("rows") * F.col("columns") / two("total")
    top, bottom = F.col("cells") - expected, (F.col("rows") + F.col("columns")) / 2 - expected
    return everything.select(F.when(bottom == 0, 1.0).otherwise(F.try_divide(top, bottom)).alias("ari"))


def precision_by_stratum(judged: DataFrame, sizes: DataFrame, stratum: str, right: str) -> DataFrame:
    """(stratum, n, hits, precision, low, high, size): precision of a labelled sample per stratum, with its interval and size."""
    per = judged.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right)).alias("hits"))
    w = wilson(F.col("hits"), F.col("n"))
    return per.join(sizes, stratum).select(stratum, "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), w["low"].alias("low"), w["high"].alias("high"), "size")


def expand_choices(answers: DataFrame, keys: list[str], rater: str, variable: str, value: str, categories: dict[str, list[str]]) -> DataFrame:
    """Answers with multiple choices (JSON lists) as one boolean variable for each category, others as they are."""
    plain = answers.where(~F.col(variable).isin(*categories)).select(*keys, rater, variable, value) if categories else answers.select(*keys, rater, variable, value)
    for name, options in categories.items():
        own = answers.where((F.col(variable) == name) & F.col(value).isNotNull()).withColumn("_chosen", F.from_json(value, "array<string>"))
        each = own.select(*keys, rater, F.explode(F.array(*(F.struct(F.lit(f"{name}:{o}").alias("v"), F.array_contains("_chosen", o).cast("string").alias("x")) for o in options))).alias("_e"))
        plain = plain.unionByName(each.select(*keys, rater, F.col("_e.v").alias(variable), F.col("_e.x").alias(value)))
    return plain


def rater_pairs(answers: DataFrame, keys: list[str], rater: str, value: str) -> DataFrame:
    """(keys, rater_a, rater_b, a, b): answers of every two raters to the same item, raters in order."""
    x = answers.select(*keys, F.col(rater).alias("rater_a"), F.col(value).alias("a"))
    y = answers.select(*keys, F.col(rater).alias("rater_b"), F.col(value).alias("b"))
    return x.join(y, keys).where("rater_a < rater_b")


def divergences(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.col("a").eqNullSafe(F.col("b")))


def circular(pairs: DataFrame, families: dict[str, str]) -> DataFrame:
    """Whether the two raters are models of one family, so that their agreement says little."""
    family = F.create_map(*(F.lit(x) for kv in families.items() for x in kv)) if families else F.create_map().cast("map<string,string>")
    a, b = F.try_element_at(family, F.col("rater_a")), F.try_element_at(family, F.col("rater_b"))
    return pairs.withColumn("circular", F.coalesce(a == b, F.lit(False)))


def valid_codings(answers: DataFrame, codebook: dict[str, list[str] | None], keys: list[str], variable: str, value: str) -> DataFrame:
    """Answers the present codebook allows; a variable without a list takes any text."""
    ok = F.lit(False)
    for name, options in codebook.items():
        ok = ok | ((F.col(variable) == name) & (F.col(value).isin(*options) if options is not None else F.col(value).isNotNull()))
    return answers.where(ok)


def complete_sheets(answers: DataFrame, variables: list[str], keys: list[str], variable: str) -> DataFrame:
    """(keys): sheets that answer every variable."""
    return answers.where(F.col(variable).isin(*variables)).groupBy(*keys).agg(F.countDistinct(variable).alias("_n")).where(F.col("_n") == len(variables)).select(*keys)


def median_kappa(pairs: DataFrame, variable: str) -> DataFrame:
    """(variable, kappa): median over pairs of raters; pairs without a kappa take no part."""
    cells = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy(variable, "rater_a", "rater_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    by = [variable, "rater_a", "rater_b"]
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*by, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    po, pe = F.col("same") / F.col("t"), F.coalesce("chance", F.lit(0)) / (F.col("t") * F.col("t"))
    return total.join(chance, by, "left").select(variable, F.when(pe < 1, (po - pe) / (1 - pe)).alias("k")).groupBy(variable).agg(F.median("k").alias("kappa"))

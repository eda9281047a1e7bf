"""Projections, unnesting, series, ranked picks and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.rounding import half_even

#: Strata, and candidate pairs of labels, that may come to the driver.
MOST_STRATA, MOST_PAIRS = 100_000, 1_000_000


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Rows numbered from ``first`` in a total order, without a task that sees them all.

    Rows are dealt out by range and numbered inside their partition; a count for
    each partition says where its numbers start.
    """
    from quillspark.session import checkpointed

    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts, start, rows = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect()), first, []
    for part, n in counts:
        rows.append((part, start))
        start += n
    starts = df.sparkSession.createDataFrame(rows, "_part int, _start long")
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_n", F.row_number().over(inside)).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_n") - 1).cast("int")).drop("_part", "_n", "_start")


def unnest(df: DataFrame, key: str, arrays: dict[str, str], tag: str = "kind") -> DataFrame:
    """Rows of several arrays of structs, one below the other, with a literal tag for each array."""
    parts = [df.select(key, F.lit(label).alias(tag), F.inline(column)) for column, label in arrays.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_ordinality(df: DataFrame, key: str, array: str, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """One row for each element, numbered from 1."""
    return df.select(key, F.posexplode(array).alias("at", value)).select(key, (F.col("at") + 1).alias(ordinal), value)


def dense_series(counts: DataFrame, key: str, year: str, n: str, totals: DataFrame) -> DataFrame:
    """(key, year, n, share): every key in every year from the first to the last of ``totals`` (year, total).

    Years without rows have 0; the share of an empty year is 0, others have five
    places. Totals are given by the caller, so they may include rows without a key.
    """
    span = totals.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(year))
    spine = counts.select(key).distinct().crossJoin(span)  # years are few
    return (
        spine.join(counts.select(key, year, n), [key, year], "left")
        .join(totals.select(year, "total"), year, "left")
        .select(key, year, F.coalesce(n, F.lit(0)).alias(n), half_even(F.coalesce(F.try_divide(F.coalesce(n, F.lit(0)), "total"), F.lit(0.0)), 5).alias("share"))
    )


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each key; of equal ones the least."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best")).select(*keys, F.col("best.v").alias(value), (-F.col("best.n")).alias("n"))


def consensus(df: DataFrame, keys: list[str], value: str, votes: int = 2, share: float = 0.8) -> DataFrame:
    """(keys, value): what a key is taken to mean, if its top value has enough votes and a large enough share."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best"), F.sum("n").alias("all"))
    return best.where((-F.col("best.n") >= votes) & (-F.col("best.n") >= share * F.col("all"))).select(*keys, F.col("best.v").alias(value))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ``order`` has to be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert by append: the last row written for each key."""
    return df.withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_last = 1").drop("_last")


def best_with_margin(df: DataFrame, keys: list[str], candidate: str, parent: str, score: str, margin: float) -> DataFrame:
    """The best candidate of each key, if no candidate with another parent comes within ``margin``.

    Two partial aggregates: the best candidate, then the best score among other
    parents; no group is sorted.
    """
    best = df.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(candidate).alias("c"), F.col(parent).alias("p"))).alias("best"))
    rival = df.join(best, keys).where(~F.col(parent).eqNullSafe(F.col("best.p"))).groupBy(*keys).agg(F.max(score).alias("rival"))
    return best.join(rival, keys, "left").where(F.col("rival").isNull() | (-F.col("best.s") - F.col("rival") >= margin)).select(*keys, F.col("best.c").alias(candidate), (-F.col("best.s")).alias(score))


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row (q0, q1, ...): values at position round(share * (n - 1)), never interpolated; halves round to even.

    Values are dealt out by range and counted per partition; only the partitions
    that hold a wanted position are numbered, so no task sees all values.
    """
    from quillspark.session import checkpointed

    own = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).repartitionByRange("v")
    dealt = checkpointed(own.select("v", F.spark_partition_id().alias("part")))
    counts = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    total, wanted = sum(n for _, n in counts), []
    for i, share in enumerate(shares):
        at = round(share * (total - 1)) if total else 0
        for part, n in counts:
            if at < n:
                wanted.append((i, part, at + 1))
                break
            at -= n
    ranked = dealt.where(F.col("part").isin(*{p for _, p, _ in wanted}) if wanted else F.lit(False)).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("v")))
    place = {i: (p, r) for i, p, r in wanted}
    return ranked.agg(*(F.min(F.when((F.col("part") == place[i][0]) & (F.col("r") == place[i][1]), F.col("v")) if i in place else F.lit(None)).alias(f"q{i}") for i in range(len(shares))))


def largest_remainder(sizes: DataFrame, n: int, stratum: str = "stratum", size: str = "size") -> DataFrame:
    """(stratum, size, allocated): n places in proportion, at least one each if that fits, never above the size.

    Strata are few by nature; a window numbers remainders (larger first, then
    name), and what the sizes cut off goes to the largest strata with room.
    """
    s = sizes.select(F.col(stratum).alias("stratum"), F.col(size).cast("long").alias("size"))
    total, strata = s.agg(F.sum("size"), F.count(F.lit(1))).first()
    n = min(n, total or 0)
    least = 1 if strata and n >= strata else 0
    # multiplied before it is divided, so that equal quotas are equal numbers
    quota = F.col("size") * F.lit(n) / F.lit(float(total or 1))
    base = s.withColumn("base", F.least("size", F.greatest(F.floor(quota), F.lit(least)))).withColumn("rest", quota - F.floor(quota))
    if (strata or 0) > MOST_STRATA:
        raise ValueError(f"{strata} strata are more than the {MOST_STRATA} that are dealt with on the driver")
    rows = [[r.stratum, r.size, r.base, r.rest] for r in base.orderBy("stratum").collect()]
    left = n - sum(r[2] for r in rows)
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if left > 0 and r[2] < r[1]:
            r[2], left = r[2] + 1, left - 1
    while left > 0:
        r = max((r for r in rows if r[2] < r[1]), key=lambda r: (r[1] - r[2], r[0]))
        step = min(left, r[1] - r[2])
        r[2], left = r[2] + step, left - step
    while left < 0:  # the guaranteed ones can take more than there is
        r = max((r for r in rows if r[2] > least), key=lambda r: (r[2], r[0]))
        r[2], left = r[2] - 1, left + 1
    return sizes.sparkSession.createDataFrame([tuple(r[:3]) for r in rows], s.schema.add("allocated", "long"))


def hash_sample(df: DataFrame, strata: DataFrame, stratum: str, key: str, seed: str = "7") -> DataFrame:
    """Rows of each stratum with the smallest SHA-256 of (seed, key), as many as ``strata`` allocates."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    return ranked.join(strata.select(F.col("stratum").alias(stratum), "allocated"), stratum).where("_rank <= allocated").drop("_rank", "allocated")


def stable_numbers(groups: DataFrame, matched: DataFrame, next_id: int) -> DataFrame:
    """(group, id): matched groups keep their id; others get new ones by (-size, group) from ``next_id``; none is reused."""
    fresh = numbered(groups.join(matched, "group", "left_anti"), [F.desc("size"), F.col("group")], "id", next_id)
    return matched.select("group", "id").unionByName(fresh.select("group", "id"))


def whitelisted(df: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of an allowed kind, how many of each other kind there are)."""
    good = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(good), df.where(~good).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def excluded(docs: DataFrame, entries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept documents, unmatched entries): documents matched by any of several keys go."""
    exploded = docs.select(F.explode(F.array(*(F.col(k).cast("string") for k in keys))).alias("entry")).where("entry IS NOT NULL").distinct()
    hit = docs
    for k in keys:
        hit = hit.join(entries.select(F.col("entry").alias(f"_{k}")), F.col(k).cast("string") == F.col(f"_{k}"), "left_anti")
    return hit, entries.join(exploded, "entry", "left_anti")


def compare_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): rows that entered, left or changed between two runs."""
    joined = before.select(key, F.col(value).alias("old"), F.lit(True).alias("was")).join(after.select(key, F.col(value).alias("new"), F.lit(True).alias("is")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "entered").when(F.col("is").isNull(), "left").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.select(key, change.alias("change")).where("change IS NOT NULL")


def jaccard(members: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, jaccard) of two labelings of the same members, for pairs that share one."""
    own = members.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    joint = own.groupBy(left, right).agg(F.count(F.lit(1)).alias("joint"))
    a = own.groupBy(left).agg(F.count(F.lit(1)).alias("na"))
    b = own.groupBy(right).agg(F.count(F.lit(1)).alias("nb"))
    return joint.join(a, left).join(b, right).select(left, right, (F.col("joint") / (F.col("na") + F.col("nb") - F.col("joint"))).alias("jaccard"))


def assignment(pairs: DataFrame, left: str, right: str, score: str, least: float) -> DataFrame:
    """(left, right, score): the one-to-one matching with the largest summed score, of pairs of at least ``least``.

    Hungarian method on the driver: labels are tens, not documents.
    """
    found = pairs.where(F.col(score) >= least).select(left, right, score).limit(MOST_PAIRS + 1).collect()
    if len(found) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} candidate pairs are too many to match on the driver")
    rows = [(r[0], r[1], float(r[2])) for r in found]
    xs, ys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    size = max(len(xs), len(ys))
    gain = {(x, y): s for x, y, s in rows}
    cost = [[-gain.get((x, y), 0.0) for y in ys] + [0.0] * (size - len(ys)) for x in xs] + [[0.0] * size for _ in range(size - len(xs))]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        reach, way, used = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < reach[j]:
                        reach[j], way[j] = now, j0
                    if reach[j] < delta:
                        delta, j1 = reach[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    reach[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [(xs[match[j] - 1], ys[j - 1], gain[xs[match[j] - 1], ys[j - 1]]) for j in range(1, len(ys) + 1) if 0 < match[j] <= len(xs) and (xs[match[j] - 1], ys[j - 1]) in gain]
    return pairs.sparkSession.createDataFrame(out, pairs.select(left, right, F.col(score).cast("double").alias(score)).schema)


#: Stands for all works in ``cumulative_reach``.
ALL_WORKS = -1


def cumulative_reach(citations: DataFrame, ranks: DataFrame, doc: str, work: str, steps: list[int]) -> DataFrame:
    """(k, documents, share): documents that cite at least one of the k most cited works; -1 for any work.

    ``ranks`` needs no more works than the largest step; it is a report's few rows.
    """
    best = citations.join(F.broadcast(ranks.where(F.col("rank") <= max(steps))), work, "left").groupBy(doc).agg(F.min("rank").alias("best"))
    own = best.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.lit(True) if k == ALL_WORKS else F.col("best") <= k).alias(f"k{i}") for i, k in enumerate(steps)))
    return own.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{i}").alias("documents"), (F.col(f"k{i}") / F.col("all")).alias("share")) for i, k in enumerate(steps)))).alias("x")).select("x.*")


def one_per_language(texts: DataFrame, keys: list[str], language: str, right: str, position: str) -> DataFrame:
    """One text for each language: one already right before others, then by position."""
    w = Window.partitionBy(*keys, language).orderBy((~F.col(right)).cast("int"), position)
    return texts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_precedence(keys: DataFrame, sources: list[DataFrame], key: str, label: str) -> DataFrame:
    """(key, label, source): the first source that has a label for a key, sources in order of precedence from 0."""
    tagged = None
    for i, s in enumerate(sources):
        part = s.select(key, label, F.lit(i).alias("source")).where(F.col(label).isNotNull())
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(key).agg(F.min(F.struct("source", label)).alias("b")).select(key, F.col(f"b.{label}").alias(label), F.col("b.source").alias("source"))
    return keys.select(key).distinct().join(best, key, "left")


def always_since(shares: DataFrame, keys: list[str], year: str, share: str, full: float = 1.0) -> DataFrame:
    """(keys, since): the first year from which on every year's share is full; null if the last year's is not."""
    broken = shares.groupBy(*keys).agg(F.max(F.when(F.col(share) < full, F.col(year))).alias("_b"))
    return shares.join(broken, keys).groupBy(*keys).agg(F.min(F.when(F.col("_b").isNull() | (F.col(year) > F.col("_b")), F.col(year))).alias("since"))


def largest_change(rows: DataFrame, period: Column, category: str, group: str) -> DataFrame:
    """(group, category, before, after): the category of each group whose share changes most between two periods.

    ``period`` is true for the later one; ties go to the least category.
    """
    own = rows.select(group, category, period.cast("int").alias("_late"))
    counts = own.groupBy(group, category).agg(F.sum(1 - F.col("_late")).alias("_k0"), F.sum("_late").alias("_k1"))
    totals = own.groupBy(group).agg(F.sum(1 - F.col("_late")).alias("_n0"), F.sum("_late").alias("_n1"))
    shares = counts.join(totals, group).select(group, category, F.try_divide("_k0", "_n0").alias("before"), F.try_divide("_k1", "_n1").alias("after"))
    change = F.round(F.abs(F.col("after") - F.col("before")), 9)
    best = shares.where(change.isNotNull()).groupBy(group).agg(F.min(F.struct((-change).alias("c"), F.col(category).alias("k"), "before", "after")).alias("b"))
    return best.select(group, F.col("b.k").alias(category), F.col("b.before").alias("before"), F.col("b.after").alias("after"))


def stacked(series: DataFrame, at: str, key: str, n: str, order: list[Column], expand: bool = False) -> DataFrame:
    """(at, key, low, high): each key's band on top of those before it, as counts or as shares of the whole."""
    w = Window.partitionBy(at).orderBy(*order)
    high = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy(at))
    scale = F.when(total > 0, total) if expand else F.lit(1)
    return series.select(at, key, F.coalesce((high - F.col(n)) / scale, F.lit(0.0)).alias("low"), F.coalesce(high / scale, F.lit(0.0)).alias("high"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each row of ``left`` with ``columns`` of the last row of ``right`` with its keys at or before its time; null before the first.

    Both sides are put in one order and the last right row is carried on, so a
    row of either side moves once. Of right rows of one time the greatest counts.
    """
    own = [c for c in left.columns if c not in (*keys, at)]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    a = left.select(*keys, at, F.struct(*own).alias("_left") if own else F.struct(F.lit(True).alias("_")).alias("_left"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, at, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*columns).alias("_right"))
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_left").isNotNull(), F.col("_right")).rowsBetween(Window.unboundedPreceding, 0)
    met = b.unionByName(a).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_left IS NOT NULL")
    return met.select(*keys, at, *(F.col(f"_left.{c}").alias(c) for c in own), *(F.col(f"_last.{c}").alias(c) for c in columns))


def within(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points and the ranges that hold them, ends included: both meet in bins of ``width``, as wide as most ranges."""
    bin_of = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return points.withColumn("_bin", bin_of(point)).join(b, "_bin").where(F.col(point).between(F.col(low), F.col(high))).drop("_bin")

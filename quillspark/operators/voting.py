"""Votes of several members on documents' variables, decisions and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.statistics import wilson

#: Evidence statuses from the best.
STATUSES = ["literal", "approximate", "waived", "absent"]


def complete_items(votes: DataFrame, keys: list[str], member: str, members: int) -> DataFrame:
    """Votes on items that all members answered."""
    full = votes.groupBy(*keys).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == members).drop("_n")
    return votes.join(full, keys, "left_semi")


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status)


def decide_single(votes: DataFrame, keys: list[str], value: str = "value", status: str = "status") -> DataFrame:
    """(keys, value, stage): a strict majority; unanimity always decides, other majorities need evidence that is not absent."""
    counts = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"), F.max((F.col(status) != "absent").cast("int")).alias("evident"))
    best = counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), F.col(value).alias("v"), "evident")).alias("b"))
    k, n = -F.col("b.k"), F.col("n")
    stage = F.when(k == n, "unanimous").when((2 * k > n) & (F.col("b.evident") == 1), "majority").otherwise("undecided")
    return best.select(*keys, F.when(stage != "undecided", F.col("b.v")).alias(value), stage.alias("stage"))


def decide_multiple(votes: DataFrame, keys: list[str], value: str = "value", status: str = "status") -> DataFrame:
    """As decide_single for arrays of categories: each category by strict majority; the set must be some member's vote."""
    own = votes.withColumn("_v", F.to_json(F.array_sort(F.array_distinct(value))))
    n = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_v").alias("kinds"), F.min("_v").alias("only"))
    each = votes.select(*keys, F.explode(F.array_distinct(value)).alias("c")).groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("k"))
    chosen = each.join(n, keys).where(2 * F.col("k") > F.col("n")).groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list("c"))).alias("_v"))
    same = own.join(chosen, [*keys, "_v"]).groupBy(*keys, "_v").agg(F.max((F.col(status) != "absent").cast("int")).alias("evident"))
    out = n.join(same, keys, "left")
    stage = F.when(F.col("kinds") == 1, "unanimous").when(F.coalesce(F.col("evident"), F.lit(0)) == 1, "majority").otherwise("undecided")
    return out.select(*keys, F.when(stage == "unanimous", F.col("only")).when(stage == "majority", F.col("_v")).alias(value), stage.alias("stage"))


def best_evidence(votes: DataFrame, keys: list[str], value: str, status: str, order: str) -> DataFrame:
    """For each item and value, the vote with the best evidence; ties by member order."""
    rank = F.row_number().over(Window.partitionBy(*keys, value).orderBy(status_rank(F.col(status)), order))
    return votes.withColumn("_r", rank).where("_r = 1").drop("_r")


def after_deliberation(first: DataFrame, second: DataFrame, keys: list[str], member: str, value: str, context: str) -> DataFrame:
    """First-round votes replaced by second-round ones that are valid and answer the same context."""
    new = second.where("valid").select(*keys, member, F.col(value).alias("_new"), F.col(context).alias("_context"))
    joined = first.join(new, [*keys, member], "left")
    same = F.col("_context") == F.col(context)
    return joined.withColumn("changed", F.coalesce(same & ~F.col("_new").eqNullSafe(F.col(value)), F.lit(False))).withColumn(value, F.coalesce(F.when(same, F.col("_new")), F.col(value))).drop("_new", "_context")


def final_decisions(round_one: DataFrame, round_two: DataFrame, supervisor: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, stage, flipped): the supervisor's valid choice, else round one, else round two, else no majority.

    A choice is valid if its candidates are those of the item (``candidates``).
    """
    two = round_two.select(*keys, F.col(value).alias("_two"), F.col("stage").alias("_stage_two"))
    sup = supervisor.select(*keys, F.col(value).alias("_sup"), F.col("candidates").alias("_candidates"))
    j = round_one.join(two, keys, "left").join(sup, keys, "left")
    valid = F.col("_candidates").eqNullSafe(F.col("candidates")) & F.col("_sup").isNotNull()
    decided = F.when(F.col("stage") != "undecided", F.col(value)).when(F.coalesce("_stage_two", F.lit("undecided")) != "undecided", F.col("_two"))
    stage = F.when(valid, "supervisor").when(F.col("stage") != "undecided", F.col("stage")).when(F.coalesce("_stage_two", F.lit("undecided")) != "undecided", "deliberation").otherwise("no_majority")
    return j.select(*keys, F.when(valid, F.col("_sup")).otherwise(decided).alias(value), stage.alias("stage"), F.coalesce(valid & (F.col("_sup") != decided), F.lit(False)).alias("flipped"))


def audit_sample(items: DataFrame, keys: list[str], n: int, seed: str = "7") -> DataFrame:
    """The n items with the lowest SHA-256 of the seed and their keys."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)
    return items.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def audit_rates(judged: DataFrame, by: str, wrong: str) -> DataFrame:
    """(by, n, errors, rate, low, high) of audited items."""
    per = judged.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(wrong)).alias("errors"))
    w = wilson(F.col("errors"), F.col("n"))
    return per.select(by, "n", "errors", (F.col("errors") / F.col("n")).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def keep_or_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A run replaces the old rows if it covers all their keys; otherwise it only adds and updates."""
    if old.join(new, key, "left_anti").isEmpty():
        return new
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without an entry in the cache."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def request_batches(items: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """Items with a batch number from 0; a window over distinct order keys, for a supervisor's few thousand items."""
    return items.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))


def import_choices(responses: DataFrame, items: DataFrame, keys: list[str], file: str, line: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): the last file wins; stale and impossible choices are refused.

    ``items`` has the keys, ``candidates_hash`` and the array ``candidates``.
    """
    ranked = responses.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(file), F.desc(line)))).where("_r = 1").drop("_r")
    j = ranked.join(items.select(*keys, F.col("candidates_hash").alias("_hash"), F.col("candidates").alias("_of")), keys, "left")
    reason = F.when(F.col("_of").isNull(), "unknown item").when(~F.col("candidates_hash").eqNullSafe(F.col("_hash")), "stale").when(~F.coalesce(F.array_contains("_of", F.col("value")), F.lit(False)), "not a candidate")
    j = j.withColumn("reason", reason).drop("_hash", "_of")
    return j.where("reason IS NULL").drop("reason"), j.where("reason IS NOT NULL")

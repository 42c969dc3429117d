"""Spend, agreement and outcome reports. Money is summed as decimals, so totals don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

MONEY, PRICE = "decimal(28,10)", "decimal(8,4)"
#: Dollars per million tokens of a model that the price table lacks.
UNKNOWN_IN, UNKNOWN_OUT = 1.5, 9.0


def price_calls(call: DataFrame, price: DataFrame) -> DataFrame:
    """Adds estimate, cost and cost_source: a valid bill wins, else the estimate by the model's price."""
    dearest = F.coalesce("price_in", F.lit(UNKNOWN_IN)), F.coalesce("price_out", F.lit(UNKNOWN_OUT))
    millionths = [F.col(n).cast("decimal(18,0)") * p.cast(PRICE) for n, p in zip(("input_tokens", "output_tokens"), dearest)]
    estimate = ((millionths[0] + millionths[1]).cast("decimal(24,4)") * F.lit("0.000001").cast("decimal(7,6)")).cast(MONEY)
    valid = F.coalesce((F.col("billed") >= 0) & (F.col("billed") < float("inf")) & ~F.isnan("billed"), F.lit(False))
    return call.join(price, "model", "left").withColumns({"estimate": estimate, "valid": valid}).select(
        *call.columns, "estimate", F.when(F.col("valid"), F.col("billed").cast(MONEY)).otherwise(F.col("estimate")).alias("cost"), F.when(F.col("valid"), "billed").otherwise("estimate").alias("cost_source")
    )


def cost_by_stage(priced: DataFrame) -> DataFrame:
    """Per run and stage, and with a null stage per run: calls, tokens, cost, and billed only if every call was."""
    return priced.rollup("run_id", "stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast("double").alias("cost"),
        F.when(F.bool_and(F.col("cost_source") == "billed"), "billed").otherwise("estimate").alias("cost_source"),
    ).where("run_id IS NOT NULL")


def spend_report(priced: DataFrame) -> DataFrame:
    """Per stage: calls, tokens, cost and share of all cost."""
    stages = priced.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
    share = F.col("cost").cast("double") / F.sum("cost").over(Window.partitionBy()).cast("double")
    return stages.select("stage", "calls", "tokens", F.col("cost").cast("double").alias("cost"), F.round(share, 6).alias("share"))


def exact_quantile(values: DataFrame, column: str, q: float) -> DataFrame:
    """One row (value): the q-quantile of a column, in between two values where it falls so; null without values.

    By rank over ranges: equal values are counted first, ranges of values are counted next, and only the ranges that hold the two ranks are looked at, so
    neither a task nor an aggregate holds more than a range.
    """
    spark, path = values.sparkSession, scratch(values.sparkSession, "ranges")
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.schema("v double, n long, part int").parquet(path)
    sizes = ranges.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each range
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("total", F.sum("size").over(Window.partitionBy()))
    at = (F.col("total") - 1) * F.lit(q)
    wanted = placed.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
    upto = Window.partitionBy("part", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranges.join(F.broadcast(wanted.select("part", "rank", "before", at.alias("at"))), "part").withColumn("upto", F.col("before") + F.sum("n").over(upto))
    hit = near.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    return hit.agg((low + (high - low) * (F.max("at") - F.min("rank"))).alias("value"))


def spend_per_run(priced: DataFrame) -> DataFrame:
    """Median, mean, least and most cost of a run."""
    runs = priced.groupBy("run_id").agg(F.sum("cost").cast("double").alias("cost"))
    whole = runs.agg(F.round(F.avg("cost"), 6).alias("mean"), F.min("cost").alias("least"), F.max("cost").alias("most"), F.count(F.lit(1)).alias("runs"))
    median = exact_quantile(runs, "cost", 0.5).select(F.round("value", 6).alias("median"))
    return median.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").select("median", "mean", "least", "most", "runs")  # a row each


def stage_overruns(timing: DataFrame, ceilings: DataFrame, default: float = 1200.0) -> DataFrame:
    return timing.join(ceilings, "stage", "left").withColumn("ceiling", F.coalesce("ceiling", F.lit(default))).where(F.col("seconds") > F.col("ceiling"))


def report_summary(result: DataFrame, key: str) -> DataFrame:
    return result.groupBy(key).agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.sum("marks_awarded"), 4).alias("awarded"), F.round(F.sum("marks_max"), 4).alias("maximum"),
        F.count_if("needs_review").alias("needs_review"), F.count_if("off_topic").alias("off_topic"), F.count_if("injection").alias("injection"),
    )


def outcome_rates(result: DataFrame, by: str) -> DataFrame:
    """Shares of zero, partial and full marks by ``by``, and over all in the row where it is null."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    got, most = F.col("marks_awarded"), F.col("marks_max")
    return result.rollup(by).agg(F.count(F.lit(1)).alias("answers"), share(got <= 0).alias("zero"), share((got > 0) & (got < most)).alias("partial"), share((got > 0) & (got >= most)).alias("full"))


def next_versions(run_state: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs whose content (run_id, content) is new or has changed since the ledger's (run_id, content_hash, version)."""
    latest = ledger.groupBy("run_id").agg(F.max_by(F.struct("content_hash", "version"), "version").alias("l")).select("run_id", F.col("l.content_hash").alias("old_hash"), F.col("l.version").alias("old_version"))
    hashed = run_state.select("run_id", F.sha2("content", 256).alias("content_hash")).join(latest, "run_id", "left")
    return hashed.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))).select("run_id", "content_hash", (F.coalesce("old_version", F.lit(0)) + 1).alias("version"))


def pending_by_hash(found: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """Texts (id, text) whose key, the hash of version, model and text, isn't in the cache (cache_key)."""
    key = F.sha2(F.concat_ws("\0", F.lit(version), F.lit(model), F.col("text")), 256)
    return found.withColumn("cache_key", key).join(cache, "cache_key", "left_anti")


def hits_by_hash(found: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """Texts (id, text) that the cache (cache_key, parsed) has, with what was parsed from them."""
    key = F.sha2(F.concat_ws("\0", F.lit(version), F.lit(model), F.col("text")), 256)
    return found.withColumn("cache_key", key).join(cache, "cache_key")


def timing_by_stage(timing: DataFrame) -> DataFrame:
    """Seconds per run and stage; with a null stage, all stages of a run."""
    return timing.rollup("run_id", "stage").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("times")).where("run_id IS NOT NULL")


def stage_overlap(timing: DataFrame, wall: DataFrame) -> DataFrame:
    """Per run the stages' seconds in all, its wall time (run_id, wall), and how much of the stages ran beside each other."""
    total = timing.groupBy("run_id").agg(F.sum("seconds").alias("stages"))
    return total.join(wall, "run_id").select("run_id", "stages", "wall", F.greatest(F.col("stages") - F.col("wall"), F.lit(0.0)).alias("overlap"))


def batch_totals(summary: DataFrame) -> DataFrame:
    """All sheets of a batch (batch_summary's rows with batch_id) together: how many, how many failed, marks and cost."""
    return summary.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("sheets"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("awarded").alias("awarded"), F.sum("maximum").alias("maximum"), F.sum("cost").alias("cost")
    )


def run_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """How well two runs over the same questions (sheet_id, base, mark) agree: questions, share of equal marks, mean difference."""
    off = F.col("mark") - F.col("other")
    both = first.select("sheet_id", "base", "mark").join(second.select("sheet_id", "base", F.col("mark").alias("other")), ["sheet_id", "base"])
    return both.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg((off == 0).cast("double")), 6).alias("equal"), F.round(F.avg(F.abs(off)), 6).alias("drift"))


def agreement(result: DataFrame, teacher: DataFrame, by: str) -> DataFrame:
    """Per ``by``: questions, both totals, mean absolute error and share of equal marks (sheet_id, base; mark, teacher_mark)."""
    off = F.abs(F.col("mark") - F.col("teacher_mark"))
    return result.join(teacher, ["sheet_id", "base"]).groupBy(by).agg(
        F.count(F.lit(1)).alias("questions"), F.sum("mark").alias("total"), F.sum("teacher_mark").alias("teacher_total"), F.round(F.avg(off), 6).alias("mean_error"), F.round(F.avg((off == 0).cast("double")), 6).alias("equal")
    )


def escalation_mix(cascaded: DataFrame) -> DataFrame:
    """Per reason: questions, and how far the deep mark is from the fast one on average."""
    return cascaded.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("deep_mark") - F.col("fast_mark")), 6).alias("drift"))


def batch_summary(sheet: DataFrame, result: DataFrame, cost: DataFrame) -> DataFrame:
    """Per sheet (sheet_id, student): awarded and greatest marks, status, and the cost read from its text (like $0.25)."""
    marks = result.groupBy("sheet_id").agg(F.round(F.sum("mark"), 2).alias("awarded"), F.round(F.sum("marks_max"), 2).alias("maximum"))
    spent = cost.select("sheet_id", F.regexp_replace("spent", "[$,]", "").try_cast("double").alias("cost"))
    status = F.when(F.col("awarded").isNull(), "failed").otherwise("done")
    return sheet.join(marks, "sheet_id", "left").join(spent, "sheet_id", "left").select("sheet_id", "student", "awarded", "maximum", status.alias("status"), "cost")

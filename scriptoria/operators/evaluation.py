"""Measures of retrieval, citations, service levels and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the parts of a configuration's score.
WEIGHTS = {"faithfulness": 0.40, "citation": 0.25, "recall_at_10": 0.20, "latency": 0.10, "cost": 0.05}


def ranking_measures(results: DataFrame, relevant: DataFrame, k: int = 10, id_col: str = "doc") -> DataFrame:
    """Recall, reciprocal rank and nDCG at ``k`` for each query that has relevant documents.

    ``results``: query, id, rank; ``relevant``: query, id.  Queries without
    results have measures of 0; repeated rows count once.
    """
    good = relevant.select("query", id_col).distinct()
    top = results.filter(F.col("rank") <= k).groupBy("query", id_col).agg(F.min("rank").alias("rank"))
    hits = good.join(top, ["query", id_col], "left")
    gain = F.when(F.col("rank").isNotNull(), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = hits.groupBy("query").agg(F.count("*").alias("n_relevant"), F.count("rank").alias("n_hits"), F.min("rank").alias("_first"), F.sum(gain).alias("_dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select("query", "n_relevant", "n_hits", F.round(F.col("n_hits") / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("_dcg") / best, 6).alias("ndcg"))


def citation_measures(cited: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision and recall of citations (``query``, ``doc_id``, ``page``) by query; null where there is nothing to divide by."""
    c, e = cited.select("query", "doc_id", "page").distinct().withColumn("_c", F.lit(1)), expected.select("query", "doc_id", "page").distinct().withColumn("_e", F.lit(1))
    both = c.join(e, ["query", "doc_id", "page"], "full")
    per = both.groupBy("query").agg(F.count("_c").alias("n_cited"), F.count("_e").alias("n_expected"), F.count_if(F.col("_c").isNotNull() & F.col("_e").isNotNull()).alias("n_right"))
    return per.select("*", F.round(F.try_divide("n_right", "n_cited"), 6).alias("precision"), F.round(F.try_divide("n_right", "n_expected"), 6).alias("recall"))


def latency_report(calls: DataFrame, *dimensions: str, accuracy: int | None = None) -> DataFrame:
    """Calls, median and 95th percentile latency and error rate for every combination of the dimensions, totals included.

    ``calls`` has ``latency`` and ``failed``, and may have ``cached``: then
    ``cache_hit_rate`` is added.  A total has null in the dimensions it is over.
    Percentiles are exact and hold a count for each distinct latency of a group;
    with ``accuracy`` they are approximate, to a rank error of 1 / ``accuracy``, from
    a sketch of bounded size.
    """
    at = (lambda p: F.percentile("latency", p)) if accuracy is None else (lambda p: F.percentile_approx("latency", p, accuracy))
    cached = [F.round(F.try_divide(F.count_if("cached"), F.count("*")), 6).alias("cache_hit_rate")] if "cached" in calls.columns else []
    return calls.cube(*dimensions).agg(
        F.count("*").alias("calls"), F.round(at(0.5), 6).alias("p50"), F.round(at(0.95), 6).alias("p95"), F.round(F.try_divide(F.count_if("failed"), F.count("*")), 6).alias("error_rate"), *cached,
    )


def stratified_sample(rows: DataFrame, strata: list[str], per_stratum: int, id_col: str, seed: int = 42) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum, chosen by a hash of the id, alike on every run."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), id_col))
    return rows.withColumn("_n", order).filter(F.col("_n") <= per_stratum).drop("_n")


def configuration_score(runs: DataFrame) -> DataFrame:
    """Runs with ``score``, the weighted sum of their parts; null parts count as 0."""
    return runs.withColumn("score", F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 6))


def cohen_kappa(labels: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """One row: ``n``, ``observed`` and ``expected`` agreement, ``kappa`` (null without rows, 1 where chance alone agrees fully)."""
    both = labels.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    cells = both.groupBy("_a", "_b").agg(F.count("*").alias("n"))
    per = cells.select(F.explode(F.array(F.struct(F.lit("a").alias("who"), F.col("_a").alias("label")), F.struct(F.lit("b").alias("who"), F.col("_b").alias("label")))).alias("x"), "n")
    margins = per.groupBy("x.label").agg(F.sum(F.when(F.col("x.who") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.who") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = margins.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).scalar()
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("n")).otherwise(0)).alias("_same"))
    n = F.col("n").cast("double")
    observed, expected = F.try_divide("_same", n), F.try_divide(chance, n * n)
    kappa = F.when(expected == 1, 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return total.select("n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(kappa, 6).alias("kappa"))


def alerts(calls: DataFrame, time_col: str = "ts", width: str = "5 minutes", max_p95: float = 8.0, max_errors: float = 0.02, late: str = "10 minutes") -> DataFrame:
    """Windows in which the 95th percentile of ``latency`` or the error rate is too high; batch or stream.

    On a stream, calls later than ``late`` are dropped by the watermark, and the
    percentile is the approximate one, whose state is bounded.
    """
    if calls.isStreaming:
        calls, p95 = calls.withWatermark(time_col, late), F.percentile_approx("latency", 0.95, 10_000)
    else:
        p95 = F.percentile("latency", 0.95)
    per = calls.groupBy(F.window(time_col, width).alias("w")).agg(F.count("*").alias("calls"), p95.alias("p95"), F.try_divide(F.count_if("failed"), F.count("*")).alias("error_rate"))
    return per.filter((F.col("p95") > max_p95) | (F.col("error_rate") > max_errors)).select(F.col("w.start").alias("window_start"), "calls", F.round("p95", 6).alias("p95"), F.round("error_rate", 6).alias("error_rate"))

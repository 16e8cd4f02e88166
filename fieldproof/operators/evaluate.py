"""Model accuracy against hand labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldproof import rules


def merge_scores(production: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per (photo_id, model): bench beats production, the last line wins.

    Both frames carry ``line_no``. The choice is a maximum over an ordered
    struct and combines before the shuffle.
    """
    fields = [c for c in production.columns if c not in ("photo_id", "model")]
    both = production.withColumn("source", F.lit(0)).unionByName(bench.withColumn("source", F.lit(1)))
    last = F.max(F.struct("source", "line_no", *[f for f in fields if f != "line_no"])).alias("last")
    return both.groupBy("photo_id", "model").agg(last).select("photo_id", "model", "last.*")


def with_truth(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of labelled photos."""
    return scores.join(truth.select("photo_id", "truth"), "photo_id")


def confusion(judged: DataFrame) -> DataFrame:
    """Photos per model, truth and predicted phase."""
    return judged.groupBy("model", "truth", F.coalesce("phase", F.lit("")).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def accuracy(judged: DataFrame) -> DataFrame:
    """Strict and lenient accuracy per class and overall.

    A class nobody labelled has 0 per cent; a model without tests has no
    overall accuracy.
    """
    depth, duct = F.col("truth") == "depth", F.col("truth") == "duct"
    counts = judged.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(depth).alias("depth_total"),
        F.count_if(depth & (F.col("phase") == "depth_measure")).alias("depth_correct"),
        F.count_if(duct).alias("duct_total"),
        F.count_if(duct & (F.col("phase") == "duct_laid")).alias("duct_correct"),
        F.count_if(duct & F.col("phase").isin(rules.LENIENT_DUCT_PHASES)).alias("duct_lenient"),
    )
    c = F.col
    zero = F.lit(0.0)
    return counts.withColumns({
        "depth_pct": F.coalesce(_pct(c("depth_correct"), c("depth_total")), zero),
        "duct_pct": F.coalesce(_pct(c("duct_correct"), c("duct_total")), zero),
        "duct_lenient_pct": F.coalesce(_pct(c("duct_lenient"), c("duct_total")), zero),
        "accuracy_pct": _pct(c("depth_correct") + c("duct_correct"), c("n_test")),
        "lenient_pct": _pct(c("depth_correct") + c("duct_lenient"), c("n_test")),
    })


def error_rates(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rates per model and class.

    ``predicted_all`` also counts predictions on unlabelled photos; both
    precisions are kept.
    """
    judged = scores.join(truth.select("photo_id", "truth"), "photo_id", "left")
    classes = [("depth", "depth_measure"), ("duct", "duct_laid")]
    spread = judged.select("model", "truth", "phase", F.explode(F.array(*[
        F.struct(F.lit(label).alias("class"), F.lit(phase).alias("target")) for label, phase in classes
    ])).alias("c")).select("model", "truth", "phase", "c.class", "c.target")
    labelled = F.col("truth").isNotNull()
    positive, hit = F.col("truth") == F.col("class"), F.coalesce(F.col("phase") == F.col("target"), F.lit(False))
    counts = spread.groupBy("model", "class").agg(
        F.count_if(labelled & positive & hit).alias("tp"), F.count_if(labelled & ~positive & hit).alias("fp"),
        F.count_if(labelled & positive & ~hit).alias("fn"), F.count_if(labelled & ~positive & ~hit).alias("tn"),
        F.count_if(hit).alias("predicted_all"),
        F.count_if(labelled & ~positive & (F.col("phase") == "paper_label")).alias("hidden_as_label"),
    )
    c = F.col
    zero = F.lit(0.0)
    return counts.withColumns({
        "precision_pct": F.coalesce(_pct(c("tp"), c("tp") + c("fp")), zero),
        "precision_all_pct": F.coalesce(_pct(c("tp"), c("predicted_all")), zero),
        "recall_pct": F.coalesce(_pct(c("tp"), c("tp") + c("fn")), zero),
        "fp_rate_pct": F.coalesce(_pct(c("fp"), c("fp") + c("tn")), zero),
    })


def bench_totals(runs: DataFrame) -> DataFrame:
    """Bench time, cost and photos accumulated over reruns."""
    return runs.groupBy("model").agg(
        F.sum("elapsed").alias("elapsed"), F.sum("cost_nano").alias("cost_nano"),
        F.sum("photos").alias("photos"), F.sum("failures").alias("failures"),
    )


def backfilled_bench(stage: DataFrame, scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Bench time of a production run, in proportion to its labelled photos.

    ``stage`` has model and elapsed; the stage size is the number of scores.
    """
    sizes = (
        scores.join(truth.select("photo_id", F.lit(True).alias("labelled")), "photo_id", "left")
        .groupBy("model").agg(
            F.count(F.lit(1)).alias("stage_n"), F.count_if("labelled").alias("bench_n"),
            F.coalesce(F.sum(F.when(F.col("labelled"), F.col("cost_nano"))), F.lit(0)).alias("bench_cost_nano"),
        )
    )
    return stage.join(sizes, "model").withColumn(
        "bench_elapsed", F.coalesce(F.try_divide(F.col("elapsed").cast("double"), F.col("stage_n")) * F.col("bench_n"), F.lit(0.0))
    )


def compare_models(bench: DataFrame, accuracy_rows: DataFrame, first: str, second: str) -> DataFrame:
    """Cost per photo, cost ratio and accuracy difference of two models."""
    both = bench.join(accuracy_rows.select("model", "accuracy_pct"), "model")

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column))).cast("double")

    return both.agg(
        F.try_divide(of(first, "cost_nano"), of(first, "photos")).alias("first_cost_per_photo"),
        F.try_divide(of(second, "cost_nano"), of(second, "photos")).alias("second_cost_per_photo"),
        F.coalesce(F.try_divide(of(first, "cost_nano"), of(second, "cost_nano")), F.lit(0.0)).alias("cost_ratio"),
        (of(first, "accuracy_pct") - of(second, "accuracy_pct")).alias("accuracy_delta"),
    )

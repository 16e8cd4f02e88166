"""Accuracy, spend and the audit log."""

from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.operators import audit, evaluate
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query

_FIRST, _SECOND = rules.PRICES[0][0], rules.PRICES[1][0]


def scores(spark, sf):
    return evaluate.merge_scores(t.production_scores(spark, sf), t.bench_scores(spark, sf))


def judged(spark, sf):
    return evaluate.with_truth(scores(spark, sf), t.truth(spark, sf))


def accuracy_rows(spark, sf):
    return evaluate.accuracy(judged(spark, sf))


@query("U2", "SELECT photo_id, model, source, line_no, phase, cost_nano FROM scores")
def merged_scores(spark, sf):
    return scores(spark, sf)


@query("J16", "SELECT photo_id, model, truth, phase FROM scores JOIN truth USING (photo_id)")
def labelled_scores(spark, sf):
    return judged(spark, sf).select("photo_id", "model", "truth", "phase")


@query("A15", "SELECT model, truth, phase AS predicted, count(*) AS n FROM scores JOIN truth USING (photo_id) GROUP BY ALL")
def confusion_matrix(spark, sf):
    return evaluate.confusion(judged(spark, sf))


@query("A16", "SELECT * FROM accuracy")
def model_accuracy(spark, sf):
    return accuracy_rows(spark, sf)


@query("A17", """SELECT *, coalesce(tp * 100::DOUBLE / nullif(tp + fp, 0), 0) AS precision_pct, coalesce(tp * 100::DOUBLE / nullif(predicted_all, 0), 0) AS precision_all_pct,
  coalesce(tp * 100::DOUBLE / nullif(tp + fn, 0), 0) AS recall_pct, coalesce(fp * 100::DOUBLE / nullif(fp + tn, 0), 0) AS fp_rate_pct FROM (
  SELECT model, class, count(*) FILTER (truth = class AND phase = target) AS tp, count(*) FILTER (truth <> class AND phase = target) AS fp,
    count(*) FILTER (truth = class AND phase <> target) AS fn, count(*) FILTER (truth <> class AND phase <> target) AS tn,
    count(*) FILTER (phase = target) AS predicted_all, count(*) FILTER (truth <> class AND phase = 'paper_label') AS hidden_as_label
  FROM scores LEFT JOIN truth USING (photo_id), (VALUES ('depth', 'depth_measure'), ('duct', 'duct_laid')) c(class, target) GROUP BY 1, 2)""")
def error_rates(spark, sf):
    return evaluate.error_rates(scores(spark, sf), t.truth(spark, sf))


def _bench_runs(spark, sf):
    """One bench run per lane of the audit log: its model, time, cost and photos."""
    events = t.audit_events(spark, sf).filter("model IS NOT NULL")
    return events.groupBy("model", "stage").agg(
        F.sum("elapsed").alias("elapsed"), F.sum(F.col("event_id") * 1000).alias("cost_nano"),
        F.count(F.lit(1)).alias("photos"), F.count_if(F.col("event") == "api_fail").alias("failures"))


_BENCH_SQL = """SELECT model, sum(elapsed)::BIGINT AS elapsed, sum(event_id * 1000)::BIGINT AS cost_nano, count(*) AS photos, count(*) FILTER (event = 'api_fail') AS failures
FROM audit_events WHERE model IS NOT NULL GROUP BY 1"""


@query("A18", _BENCH_SQL)
def bench_totals(spark, sf):
    return evaluate.bench_totals(_bench_runs(spark, sf))


@query("A18", """SELECT model, elapsed, stage_n, bench_n, bench_cost_nano, elapsed::DOUBLE / stage_n * bench_n AS bench_elapsed FROM
 (SELECT model, sum(elapsed)::BIGINT AS elapsed FROM stage_runs GROUP BY 1) JOIN
 (SELECT model, count(*) AS stage_n, count(truth) AS bench_n, (coalesce(sum(cost_nano) FILTER (truth IS NOT NULL), 0))::BIGINT AS bench_cost_nano
  FROM scores LEFT JOIN truth USING (photo_id) GROUP BY 1) USING (model)""")
def backfilled_bench(spark, sf):
    stage = audit.seconds_by_model(t.audit_events(spark, sf)).select("model", "elapsed")
    return evaluate.backfilled_bench(stage, scores(spark, sf), t.truth(spark, sf))


@query("A18", f"""SELECT a.cost_nano::DOUBLE / a.photos AS first_cost_per_photo, b.cost_nano::DOUBLE / b.photos AS second_cost_per_photo,
  a.cost_nano::DOUBLE / b.cost_nano AS cost_ratio, x.accuracy_pct - y.accuracy_pct AS accuracy_delta
FROM ({_BENCH_SQL}) a JOIN accuracy x USING (model), ({_BENCH_SQL}) b JOIN accuracy y USING (model) WHERE a.model = '{_FIRST}' AND b.model = '{_SECOND}'""")
def model_comparison(spark, sf):
    return evaluate.compare_models(evaluate.bench_totals(_bench_runs(spark, sf)), accuracy_rows(spark, sf), _FIRST, _SECOND)


@query("W4", "SELECT stage, model, start_id, end_id, elapsed FROM stage_runs")
def stage_runs(spark, sf):
    return audit.stage_runs(t.audit_events(spark, sf))


@query("A10", """SELECT q.model, photos, cost_nano, coalesce(elapsed, 0)::BIGINT AS elapsed, n_test, accuracy_pct FROM
 (SELECT model, count(*) AS photos, sum(cost_nano)::BIGINT AS cost_nano FROM quality GROUP BY 1) q
 LEFT JOIN (SELECT model, sum(elapsed) AS elapsed FROM stage_runs GROUP BY 1) USING (model) LEFT JOIN accuracy USING (model)""")
def spend_by_model(spark, sf):
    return audit.spend_by_model(t.quality(spark, sf), t.audit_events(spark, sf), accuracy_rows(spark, sf))


@query("A21", "SELECT stage, event, count(*) AS n FROM audit_events GROUP BY 1, 2")
def audit_funnel(spark, sf):
    return audit.funnel(t.audit_events(spark, sf))


@query("A21", """SELECT stage, event, count(*) AS n FROM (
  SELECT 'geomatch' AS stage, 'off_cluster' AS event FROM photos WHERE fcp_assignment = 'off_cluster'
  UNION ALL SELECT 'geomatch', 'latlon_address_mismatch' FROM photos WHERE latlon_vs_address_flag
  UNION ALL SELECT 'geomatch', 'drop_no_coords' FROM photos WHERE k % 31 = 0
  UNION ALL SELECT 'geomatch', 'label_mismatch' FROM photos WHERE k % 3 = 0
  UNION ALL SELECT 'classify', 'drop_no_segment' FROM photos WHERE k % 31 = 0 OR segment_id IS NULL
  UNION ALL SELECT 'classify', 'drop_no_qc' FROM photos WHERE k % 31 <> 0 AND segment_id IS NOT NULL AND photo_id NOT IN (SELECT photo_id FROM quality)) GROUP BY 1, 2""")
def drop_funnel(spark, sf):
    nowhere = F.col("k") % 31 == 0
    geomatch = t.photos(spark, sf).withColumns({
        "coord_source": F.when(nowhere, "none").otherwise("overlay_latlon"),
        "segment_id": F.when(~nowhere, F.col("segment_id")),
        "label_match": F.when(F.col("k") % 3 == 0, "r_mismatch").otherwise("ok"),
    })
    return audit.funnel(audit.drop_events(t.quality(spark, sf), geomatch, t.quality(spark, sf)))

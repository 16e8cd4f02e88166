"""Gate, dedup, gaps and verdicts."""

from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions.gate import ela_flag, ela_score, photo_label
from fieldproof.operators import coverage as cov
from fieldproof.operators.mapsets import coverage_gaps as gap_lines
from fieldproof.operators.mapsets import verdict_map as lines_with_verdict
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query
from fieldproof.plans.oracle_views import rounded

VERDICT_SQL = ", ".join(cov.VERDICT_COLUMNS)


def judged(spark, sf):
    return cov.judge(t.photos(spark, sf))


def entries(spark, sf):
    return cov.dedup_entries(judged(spark, sf))


def verdict_rows(spark, sf):
    return cov.verdicts(t.segments(spark, sf), entries(spark, sf))


@query("P15", "SELECT photo_id, compliant, array_to_string(codes, '; ') AS reasons FROM judged")
def compliance_gate(spark, sf):
    return judged(spark, sf).select("photo_id", "compliant", F.array_join("reasons", "; ").alias("reasons"))


@query("P16", f"""SELECT photo_id, CASE WHEN relevance IS DISTINCT FROM 'scorable' THEN 'DROP' WHEN personal_data_visible = 'yes' THEN 'WITHHELD'
  WHEN n = 0 THEN 'PASS' WHEN n <= 2 THEN 'WARN' ELSE 'FAIL' END AS label
FROM (SELECT *, {' + '.join(f"({c} = 'no')::INT" for c in rules.PHOTO_CHECKS)} AS n FROM photos)""")
def photo_labels(spark, sf):
    checks = [F.col(c) for c in rules.PHOTO_CHECKS]
    return t.photos(spark, sf).select(
        "photo_id", photo_label(F.col("relevance"), F.col("personal_data_visible"), checks).alias("label"))


@query("P31", f"SELECT photo_id, {rounded('ela_raw', 4)} AS ela_score, ela_raw > 15 AS ela_flag FROM photos")
def tamper_flags(spark, sf):
    raw = F.col("ela_raw")
    return t.photos(spark, sf).select("photo_id", ela_score(raw).alias("ela_score"), ela_flag(raw).alias("ela_flag"))


@query("W1", "SELECT segment_id, cluster_id::VARCHAR AS cluster_id, photo_id, segment_t, compliant FROM entries")
def evidence_dedup(spark, sf):
    return entries(spark, sf).select("segment_id", "cluster_id", "photo_id", "segment_t", "compliant")


@query("W2", "SELECT segment_id, gap_no::INT AS gap_no, from_m, to_m, gap_m FROM gaps")
def position_gaps(spark, sf):
    state = cov.segment_state(t.segments(spark, sf), entries(spark, sf)).filter("compliant_photo_count > 0")
    return state.select("segment_id", F.posexplode(cov.gaps(F.col("positions"), F.col("length_m"))).alias("gap_no", "g")).select(
        "segment_id", "gap_no", "g.from_m", "g.to_m", "g.gap_m")


@query("W3", """SELECT segment_id, gap_no::INT AS gap_no, from_m, to_m, gap_m,
  CASE WHEN gap_no = 0 THEN 'start' WHEN gap_no = n_positions THEN 'end' ELSE 'between' END AS place FROM worst""")
def worst_gap(spark, sf):
    state = cov.segment_state(t.segments(spark, sf), entries(spark, sf)).filter("compliant_photo_count > 0")
    worst = state.withColumn("w", cov.worst_gap(cov.gaps(F.col("positions"), F.col("length_m"))))
    return worst.select(
        "segment_id", "w.gap_no", "w.from_m", "w.to_m", "w.gap_m",
        F.when(F.col("w.gap_no") == 0, "start").when(F.col("w.gap_no") == F.size("positions"), "end").otherwise("between").alias("place"))


@query("A3", "SELECT segment_id, photo_count, compliant_photo_count, personal_count FROM state")
def segment_rollup(spark, sf):
    return cov.segment_state(t.segments(spark, sf), entries(spark, sf)).select(
        "segment_id", "photo_count", "compliant_photo_count", "personal_count")


@query("A4", "SELECT segment_id, verdict, raw_gap_m, coalesce(gap_reason, '') AS gap_reason FROM ruled")
def verdict_rule(spark, sf):
    state = cov.segment_state(t.segments(spark, sf), entries(spark, sf))
    return cov.with_verdict(state).select("segment_id", "verdict", "raw_gap_m", F.coalesce("gap_reason", F.lit("")).alias("gap_reason"))


@query("A5", "SELECT segment_id, string_agg(n || 'x ' || reason, '; ' ORDER BY rank) AS reasons FROM reason_ranks WHERE rank <= 3 GROUP BY 1")
def top_failure_reasons(spark, sf):
    return cov.top_reasons(entries(spark, sf)).select("segment_id", F.array_join("top_reasons", "; ").alias("reasons"))


@query("A3, A4, A5", f"SELECT {VERDICT_SQL} FROM verdicts")
def segment_verdicts(spark, sf):
    return verdict_rows(spark, sf)


@query("O1", f"SELECT {VERDICT_SQL} FROM verdicts ORDER BY CASE verdict WHEN 'RED' THEN 0 WHEN 'YELLOW' THEN 1 ELSE 2 END, length_m DESC, segment_id")
def verdicts_in_order(spark, sf):
    return cov.in_report_order(verdict_rows(spark, sf))


@query("J17", """SELECT segment_id, fcp_name, length_m, 0::BIGINT AS photo_count, 0::BIGINT AS compliant_photo_count, length_m AS max_gap_m,
  0::DOUBLE AS density_photos_per_5m, 'RED' AS verdict, 'no compliant photos snapped' AS reasons FROM segments""")
def seed_verdicts(spark, sf):
    return cov.seed_verdicts(t.segments(spark, sf))




def _some_verdicts(spark, sf):
    return verdict_rows(spark, sf).filter("length_m <> 7.0")


@query("J14, P28", """SELECT s.segment_id, coalesce(v.verdict, 'RED') AS verdict, coalesce(v.photo_count, 0) AS photo_count, coalesce(v.reasons, '') AS reasons,
  CASE WHEN coalesce(s.is_connected_to_home, false) THEN 'house' ELSE 'trunk' END AS layer
FROM segments s LEFT JOIN (SELECT * FROM verdicts WHERE length_m <> 7) v USING (segment_id)""")
def verdict_map(spark, sf):
    return lines_with_verdict(t.segments(spark, sf), _some_verdicts(spark, sf)).select(
        "segment_id", "verdict", "photo_count", "reasons", "layer")


@query("P27", """SELECT s.segment_id, coalesce(v.verdict, 'RED') AS verdict FROM segments s
LEFT JOIN (SELECT * FROM verdicts WHERE length_m <> 7) v USING (segment_id) WHERE coalesce(v.photo_count, 0) = 0""")
def coverage_gaps(spark, sf):
    return gap_lines(t.segments(spark, sf), _some_verdicts(spark, sf)).select("segment_id", "verdict")


@query("P28", """SELECT CASE WHEN coalesce(is_connected_to_home, false) THEN 'house' ELSE 'trunk' END AS layer, count(*) AS lines,
  sum(length_m::BIGINT)::BIGINT AS metres FROM segments GROUP BY 1""")
def network_layers(spark, sf):
    layer = F.when(F.coalesce("is_connected_to_home", F.lit(False)), "house").otherwise("trunk")
    return t.segments(spark, sf).groupBy(layer.alias("layer")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("length_m").cast("bigint")).alias("metres"))

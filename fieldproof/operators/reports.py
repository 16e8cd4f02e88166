"""Report tables, KPIs and picks derived from verdicts and per-photo rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions.gate import photo_label
from fieldproof.functions.text import first_reason, is_no_photos_only, list_id, model_family, report_id, strip_text

_NOT_GREEN = "upper(coalesce(verdict, '')) <> 'GREEN'"


def deficiencies(verdicts: DataFrame) -> DataFrame:
    """Non-green segments by zone, longest first (O2)."""
    return verdicts.filter(_NOT_GREEN).select(
        "segment_id", "fcp_name", "verdict", "length_m", "photo_count", "compliant_photo_count",
        "max_gap_m", "density_photos_per_5m", "reasons",
    ).orderBy("fcp_name", F.desc("length_m"), "segment_id")


def not_classified(quality: DataFrame) -> DataFrame:
    """Photos the relevance gate refused, with path, cause and note (O3)."""
    note = strip_text(F.coalesce("note", F.lit("")))
    return (
        quality.filter("relevance <> 'scorable'")
        .select("photo_id", "rel_path", F.concat_ws(" — ", "relevance", F.nullif(note, F.lit(""))).alias("reason"))
        .orderBy("reason", "photo_id")
    )


def personal_data(quality: DataFrame) -> DataFrame:
    """Photos showing personal data, with path (O3)."""
    return quality.filter("personal_data_visible = 'yes'").select("photo_id", "rel_path").orderBy("photo_id")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Segments per verdict."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("segments"))


def zone_sizes(segments: DataFrame) -> DataFrame:
    """Segments per zone."""
    return segments.groupBy("fcp_name").agg(F.count(F.lit(1)).alias("segments"))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Side by side join of single-row aggregates."""
    joined = frames[0].withColumn("_one", F.lit(1))
    for frame in frames[1:]:
        joined = joined.join(frame.withColumn("_one", F.lit(1)), "_one")
    return joined.drop("_one")


def summary(verdicts: DataFrame, quality: DataFrame, clusters: DataFrame, geomatch: DataFrame) -> DataFrame:
    """Headline buckets of a run as one row."""
    family = model_family(F.lower(F.coalesce("model", F.lit(""))))
    cost = F.coalesce("cost_nano", F.lit(0))
    return _one_row(
        verdicts.agg(
            F.count(F.lit(1)).alias("n_segments"),
            *[F.count_if(F.upper("verdict") == v).alias(f"n_{v.lower()}") for v in ("GREEN", "YELLOW", "RED")],
        ),
        quality.agg(
            F.count(F.lit(1)).alias("n_photos_scored"),
            F.coalesce(F.sum(cost), F.lit(0)).alias("total_cost_nano"),
            *[F.count_if(family == m).alias(f"n_{m}") for m in ("sonnet", "haiku")],
            *[F.coalesce(F.sum(F.when(family == m, cost)), F.lit(0)).alias(f"cost_nano_{m}") for m in ("sonnet", "haiku")],
            F.count_if(F.col("personal_data_visible") == "yes").alias("n_personal_data"),
            F.count_if(F.coalesce("relevance", F.lit("scorable")) != "scorable").alias("n_not_classified"),
        ),
        clusters.agg(
            F.count_if(~F.coalesce("is_representative", F.lit(True))).alias("n_duplicates"),
            F.count_if("ela_flag").alias("n_ela"),
        ),
        geomatch.agg(F.count_if("latlon_vs_address_flag").alias("n_geo_mismatch")),
    )


def photo_intake(quality: DataFrame, clusters: DataFrame, geomatch: DataFrame) -> DataFrame:
    """Photo-level counters for the report cover."""
    scorable = F.coalesce("relevance", F.lit("scorable")) == "scorable"
    personal = F.coalesce(F.col("personal_data_visible") == "yes", F.lit(False))
    return _one_row(
        quality.agg(
            F.count(F.lit(1)).alias("n_uploaded"),
            F.count_if(scorable & ~personal).alias("n_passed_per_photo"),
            F.count_if(personal).alias("n_personal_data"),
            F.count_if(~scorable).alias("n_not_classified"),
            F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("total_cost_nano"),
        ),
        clusters.agg(
            F.count_if(~F.coalesce("is_representative", F.lit(True))).alias("n_duplicates"),
            F.count_if("ela_flag").alias("n_ela_flag"),
        ),
        geomatch.agg(F.count_if("latlon_vs_address_flag").alias("n_geo_mismatch")),
    )


def kpis(verdicts: DataFrame) -> DataFrame:
    """Coverage and quality shares, zero-safe."""
    counts = verdicts.agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("photo_count") > 0).alias("n_with_photos"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("GREEN", "YELLOW", "RED")],
    )
    def share(part, whole):
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)) * 100, F.lit(0.0))

    return counts.withColumns({
        "pct_coverage": share("n_with_photos", "n_segments"), "pct_quality": share("n_green", "n_with_photos"),
    })


def segment_addresses(geomatch: DataFrame, quality: DataFrame) -> DataFrame:
    """Address most often stamped on a segment's photos, ties alphabetical."""
    stamped = quality.select("photo_id", strip_text(F.coalesce("overlay_address", F.lit(""))).alias("address"))
    counted = (
        geomatch.filter("coalesce(segment_id, '') <> ''").select("photo_id", "segment_id")
        .join(stamped.filter("address <> ''"), "photo_id")
        .groupBy("segment_id", "address").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("order"), "address")).alias("best")
    return counted.groupBy("segment_id").agg(best).select(
        "segment_id", F.col("best.address").alias("address"), (-F.col("best.order")).alias("photos")
    )


def failure_buckets(verdicts: DataFrame) -> DataFrame:
    """(segment_id, bucket): failure modes of non-green segments, once per segment.

    A reason goes to the first bucket that matches and was not used yet on its
    segment, so a repeated reason may move on to a later one.
    """
    def assign(seen, reason):
        options = [
            F.when(
                F.array_contains(F.transform(F.array(*map(F.lit, keys)), lambda k: reason.contains(k)), True)
                & ~F.array_contains(seen, label), F.lit(label))
            for keys, label in rules.FAILURE_BUCKETS
        ]
        return F.array_compact(F.concat(seen, F.array(F.coalesce(*options))))

    parts = F.transform(F.split(F.coalesce("reasons", F.lit("")), ";"), strip_text)
    labels = F.aggregate(parts, F.array().cast("array<string>"), assign)
    return verdicts.filter(_NOT_GREEN).select("segment_id", F.explode(labels).alias("bucket"))


def dominant_issue(verdicts: DataFrame) -> DataFrame:
    """The failure mode behind most segments, if it explains at least two."""
    order = F.create_map(*[F.lit(v) for i, (_, label) in enumerate(rules.FAILURE_BUCKETS) for v in (label, i)])
    return (
        failure_buckets(verdicts).groupBy("bucket").agg(F.count(F.lit(1)).alias("segments"))
        .orderBy(F.desc("segments"), F.element_at(order, F.col("bucket"))).limit(1)
        .filter(F.col("segments") >= 2)
    )


def top_reason_texts(verdicts: DataFrame, k: int = 6) -> DataFrame:
    """Most frequent whole reason texts of non-green segments."""
    return (
        verdicts.filter(_NOT_GREEN).groupBy(F.coalesce("reasons", F.lit("")).alias("reasons"))
        .agg(F.count(F.lit(1)).alias("segments")).orderBy(F.desc("segments"), "reasons").limit(k)
    )


def run_shape(verdicts: DataFrame) -> DataFrame:
    """Flagged share and the split into untouched and individually failing segments."""
    flagged = F.expr(_NOT_GREEN)
    untouched = flagged & is_no_photos_only(F.col("reasons"))
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(flagged).alias("n_flagged"),
        F.count_if(untouched).alias("n_no_photos"), F.count_if(flagged & ~untouched).alias("n_unique_issue"),
        F.bround(F.lit(100.0) * F.count_if(flagged) / F.greatest(F.count(F.lit(1)), F.lit(1)), 0).cast("bigint").alias("flagged_pct"),
    )


def zone_digest(verdicts: DataFrame, cap: int = rules.NO_PHOTO_LIST_CAP) -> DataFrame:
    """Per zone: flagged and untouched segments, untouched metres, a capped id list.

    Only the displayed list is capped; the remainder is counted in n_more.
    """
    bad = verdicts.filter(_NOT_GREEN).withColumn("untouched", is_no_photos_only(F.col("reasons")))
    totals = bad.groupBy("fcp_name").agg(
        F.count(F.lit(1)).alias("n_flagged"), F.count_if("untouched").alias("n_no_photos"),
        F.coalesce(F.sum(F.when(F.col("untouched"), F.col("length_m").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("no_photo_m"),
    )
    order = Window.partitionBy("fcp_name").orderBy("segment_id")
    listed = (
        bad.filter("untouched").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
        .groupBy("fcp_name").agg(F.array_sort(F.collect_list(F.struct("rank", report_id(F.col("segment_id")).alias("id")))).alias("ids"))
    )
    return totals.join(listed, "fcp_name", "left").select(
        "fcp_name", "n_flagged", "n_no_photos", "no_photo_m",
        F.coalesce(F.array_join(F.transform("ids", lambda r: r["id"]), ", "), F.lit("")).alias("listed"),
        F.greatest(F.col("n_no_photos") - cap, F.lit(0)).alias("n_more"),
    )


def passing_segments(verdicts: DataFrame) -> DataFrame:
    """Passing segment ids by zone, one row each."""
    return (
        verdicts.filter("verdict = 'GREEN'")
        .select("fcp_name", report_id(F.col("segment_id")).alias("short_id")).orderBy("fcp_name", "short_id")
    )


def needs_attention(verdicts: DataFrame, k: int = 6) -> DataFrame:
    """Short list for the side rail: verdict name order, longest first."""
    return (
        verdicts.filter("verdict <> 'GREEN'").orderBy("verdict", F.desc("length_m"), "segment_id").limit(k)
        .select("segment_id", list_id(F.col("segment_id")).alias("short_id"), "verdict", "length_m",
                first_reason(F.col("reasons")).alias("why"))
    )


def longest_per_verdict(verdicts: DataFrame, k: int = 5) -> DataFrame:
    """The k longest segments of each verdict."""
    order = Window.partitionBy("verdict").orderBy(F.desc("length_m"), "segment_id")
    return (
        verdicts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("verdict", "rank", "segment_id", "fcp_name", "length_m", "photo_count", "reasons")
    )


def busiest_segment(geomatch: DataFrame, photo_ids: DataFrame) -> DataFrame:
    """Segment with most of the given photos, ties by id."""
    return (
        geomatch.filter("coalesce(segment_id, '') <> ''").join(photo_ids.select("photo_id"), "photo_id", "left_semi")
        .groupBy("segment_id").agg(F.count(F.lit(1)).alias("photos"))
        .orderBy(F.desc("photos"), "segment_id").limit(1)
    )


def example_segments(verdicts: DataFrame, geomatch: DataFrame, quality: DataFrame, clusters: DataFrame) -> DataFrame:
    """One showcase segment per scenario."""
    longest = verdicts.filter("verdict = 'RED'").orderBy(F.desc("length_m"), "segment_id").limit(1)
    personal = busiest_segment(geomatch, quality.filter("personal_data_visible = 'yes'"))
    copies = busiest_segment(geomatch, clusters.filter("NOT coalesce(is_representative, false)"))
    return (
        longest.select(F.lit("red_gap").alias("scenario"), "segment_id")
        .unionByName(personal.select(F.lit("personal_data").alias("scenario"), "segment_id"))
        .unionByName(copies.select(F.lit("duplicate").alias("scenario"), "segment_id"))
    )


def segment_photos(geomatch: DataFrame, segment_id: str | None = None) -> DataFrame:
    """Evidence list by position, of one segment or of all."""
    rows = geomatch.filter("coalesce(segment_id, '') <> ''")
    if segment_id is not None:
        rows = rows.filter(F.col("segment_id") == segment_id)
    return rows.orderBy("segment_id", "segment_t", "photo_id")


def batch_summary(uploads: DataFrame) -> DataFrame:
    """Labels, errors and spend of an upload batch.

    ``uploads`` carries err, cost_nano and the check columns.
    """
    scored = F.col("err").isNull()
    label = F.when(scored, photo_label(F.col("relevance"), F.col("personal_data_visible"), [F.col(c) for c in rules.PHOTO_CHECKS]))
    return uploads.groupBy(F.coalesce(label, F.lit("ERROR")).alias("label")).agg(
        F.count(F.lit(1)).alias("photos"),
        F.coalesce(F.sum(F.when(scored, F.col("cost_nano"))), F.lit(0)).alias("spend_nano"),
    )


def masked_evidence(quality: DataFrame) -> DataFrame:
    """Display set without sensitive columns; rows with personal data keep only their id (P20)."""
    withheld = F.coalesce(F.col("personal_data_visible") == "yes", F.lit(False))
    shown = [c for c in quality.columns if c not in rules.SENSITIVE_COLUMNS]
    return quality.select(*[
        F.col(c) if c in ("photo_id", "personal_data_visible") else F.when(~withheld, F.col(c)).alias(c) for c in shown
    ])

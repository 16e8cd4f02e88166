"""From judged photos to one verdict per planned segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions.gate import gate_reasons
from fieldproof.functions.numbers import exact_round, whole_text

VERDICT_COLUMNS = [
    "segment_id", "fcp_name", "length_m", "photo_count", "compliant_photo_count",
    "max_gap_m", "density_photos_per_5m", "verdict", "reasons",
]


def judge(photos: DataFrame) -> DataFrame:
    """Add the gate's failure codes and the resulting flag."""
    return photos.withColumn("reasons", gate_reasons()).withColumn(
        "compliant", F.size("reasons") == 0
    )


def dedup_entries(judged: DataFrame) -> DataFrame:
    """One entry per (segment, cluster): compliant, then representative, then lowest id.

    The choice is a minimum over an ordered struct, so copies collapse before
    the shuffle and no group of copies is ever held in one place. Photos
    without a cluster share the id -1.
    """
    ranked = F.struct(
        (~F.col("compliant")).alias("failed"),
        (~F.coalesce("is_representative", F.lit(False))).alias("is_copy"),
        F.col("photo_id"),
        F.coalesce("segment_t", F.lit(0.0)).alias("segment_t"),
        F.col("reasons"),
    )
    return (
        judged.filter(F.coalesce("segment_id", F.lit("")) != "")
        .groupBy("segment_id", F.coalesce(F.col("cluster_id").cast("string"), F.lit("-1")).alias("cluster_id"))
        .agg(F.min(ranked).alias("entry"))
        .select(
            "segment_id", "cluster_id", "entry.photo_id", "entry.segment_t", "entry.reasons",
            (~F.col("entry.failed")).alias("compliant"),
            (~F.col("entry.is_copy")).alias("is_representative"),
        )
    )


def rollup(entries: DataFrame) -> DataFrame:
    """Counts and distinct compliant positions per segment (A3).

    Positions carry four decimals, so a segment has at most 10,001 of them
    however many photos it collects; the set is built on the map side.
    """
    return entries.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("photo_count"),
        F.count_if("compliant").alias("compliant_photo_count"),
        F.count_if(F.array_contains("reasons", "personal_data_visible")).alias("personal_count"),
        F.sort_array(F.collect_set(F.when(F.col("compliant"), F.col("segment_t")))).alias("positions"),
    )


def top_reasons(entries: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent failure codes per segment, ties by code (A5)."""
    counted = (
        entries.filter(~F.col("compliant"))
        .select("segment_id", F.explode("reasons").alias("reason"))
        .groupBy("segment_id", "reason").count()
    )
    order = Window.partitionBy("segment_id").orderBy(F.desc("count"), F.asc("reason"))
    return (
        counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .groupBy("segment_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "count", "reason"))).alias("ranked"))
        .select(
            "segment_id",
            F.transform(
                "ranked", lambda r: F.concat(r["count"].cast("string"), F.lit("x "), r["reason"])
            ).alias("top_reasons"),
        )
    )


def gaps(positions: Column, length: Column) -> Column:
    """array<struct(from_m, to_m, gap_m)>: start gap, gaps between photos, end gap."""
    metres = F.transform(positions, lambda t: t * length)
    return F.zip_with(
        F.concat(F.array(F.lit(0.0)), metres),
        F.concat(metres, F.array(length)),
        lambda a, b: F.struct(a.alias("from_m"), b.alias("to_m"), (b - a).alias("gap_m")),
    )


def worst_gap(gap_array: Column) -> Column:
    """struct(gap_no, from_m, to_m, gap_m) of the first largest gap."""
    widths = F.transform(gap_array, lambda g: g["gap_m"])
    number = F.array_position(widths, F.array_max(widths)).cast("int")
    gap = F.element_at(gap_array, number)
    return F.struct((number - 1).alias("gap_no"), gap["from_m"].alias("from_m"),
                    gap["to_m"].alias("to_m"), gap["gap_m"].alias("gap_m"))


def with_verdict(segments: DataFrame) -> DataFrame:
    """Verdict, largest gap and gap reason from length_m, compliant count and positions (A4)."""
    length, n = F.col("length_m"), F.col("compliant_photo_count")
    limit = F.lit(rules.GREEN_MAX_GAP_M)
    worst = segments.withColumn("worst", worst_gap(gaps(F.col("positions"), length)))
    gap, last = F.col("worst.gap_m"), F.size("positions")
    # A shared position widens no gap, so the number of the end gap counts distinct positions.
    described = (
        F.when(F.col("worst.gap_no") == 0, F.concat(
            F.lit("first compliant photo at meter "), whole_text(F.col("worst.to_m")),
            F.lit(" (>5m from start)")))
        .when(F.col("worst.gap_no") == last, F.concat(
            F.lit("last compliant photo at meter "), whole_text(F.col("worst.from_m")),
            F.lit(" (>5m from end of "), whole_text(length), F.lit("m)")))
        .otherwise(F.concat(
            F.lit("max gap "), whole_text(gap), F.lit("m > 5m between meter "),
            whole_text(F.col("worst.from_m")), F.lit(" and meter "), whole_text(F.col("worst.to_m"))))
    )
    sparse = n / F.nullif(length, F.lit(0.0)) < F.lit(rules.RED_MIN_DENSITY_PER_M)
    def outcome(verdict: str, width: Column, reason: Column | str | None) -> Column:
        text = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        return F.struct(F.lit(verdict).alias("verdict"), width.alias("gap"), text.alias("reason"))

    density = F.concat(F.lit("density "), n.cast("string"), F.lit("/"), whole_text(length), F.lit("m below 1/10m"))
    rule = (
        F.when(n == 0, outcome("RED", length, rules.NO_PHOTO_REASONS[0]))
        .when(length <= limit, outcome("GREEN", F.lit(0.0), None))
        .when(sparse, outcome("RED", gap, density))
        .when(gap <= limit, outcome("GREEN", gap, None))
        .otherwise(outcome("YELLOW", gap, described))
    )
    return worst.withColumn("rule", rule).select(
        *segments.columns, "rule.verdict", F.col("rule.gap").alias("raw_gap_m"),
        F.col("rule.reason").alias("gap_reason"),
    )


def segment_state(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """Every planned segment with its rollup, zero-photo segments included."""
    return (
        segments.select("segment_id", "fcp_name", "length_m")
        .join(rollup(entries), "segment_id", "left")
        .withColumns({
            "photo_count": F.coalesce("photo_count", F.lit(0)),
            "compliant_photo_count": F.coalesce("compliant_photo_count", F.lit(0)),
            "personal_count": F.coalesce("personal_count", F.lit(0)),
            "positions": F.coalesce("positions", F.array().cast("array<double>")),
        })
    )


def verdicts(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """One verdict row per planned segment (A3, A4, A5)."""
    length = F.col("length_m")
    density = F.when(length > 0, F.col("compliant_photo_count") / (F.nullif(length, F.lit(0.0)) / 5.0)).otherwise(0.0)
    personal = F.when(
        F.col("personal_count") > 0,
        F.concat(F.col("personal_count").cast("string"), F.lit(" personal-data photo(s)")),
    )
    parts = F.concat(
        F.array_compact(F.array("gap_reason")),
        F.coalesce("top_reasons", F.array().cast("array<string>")),
        F.array_compact(F.array(personal)),
    )
    return (
        with_verdict(segment_state(segments, entries))
        .join(top_reasons(entries), "segment_id", "left")
        .select(
            "segment_id", "fcp_name", exact_round(length, 2).alias("length_m"),
            "photo_count", "compliant_photo_count",
            exact_round(F.col("raw_gap_m"), 2).alias("max_gap_m"),
            exact_round(density, 3).alias("density_photos_per_5m"),
            "verdict", F.array_join(parts, "; ").alias("reasons"),
        )
    )


def coverage(photos: DataFrame, segments: DataFrame) -> DataFrame:
    """Gate, dedup and verdict in one chain: the batch classification."""
    return verdicts(segments, dedup_entries(judge(photos)))


def in_report_order(verdict_rows: DataFrame) -> DataFrame:
    """RED, YELLOW, GREEN, longest first, segment id last (O1)."""
    rank = F.when(F.col("verdict") == "RED", 0).when(F.col("verdict") == "YELLOW", 1).otherwise(2)
    return verdict_rows.orderBy(rank, F.desc("length_m"), "segment_id")


def seed_verdicts(segments: DataFrame) -> DataFrame:
    """The verdict rows of a network nobody has photographed yet."""
    length = exact_round(F.col("length_m"), 2)
    return segments.select(
        "segment_id", F.coalesce("fcp_name", F.lit("")).alias("fcp_name"), length.alias("length_m"),
        F.lit(0).cast("bigint").alias("photo_count"),
        F.lit(0).cast("bigint").alias("compliant_photo_count"),
        length.alias("max_gap_m"), F.lit(0.0).alias("density_photos_per_5m"),
        F.lit("RED").alias("verdict"), F.lit(rules.NO_PHOTO_REASONS[0]).alias("reasons"),
    )

"""Per-photo rules: compliance gate, display label, tamper flag, call cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions.numbers import exact_round, whole_text


def _shown(value: Column) -> Column:
    """A missing attribute is spelled out in reason codes."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def gate_reasons(
    relevance="relevance", personal="personal_data_visible", address_flag="latlon_vs_address_flag",
    assignment="fcp_assignment", snap="snap_distance_m", phase="phase",
) -> Column:
    """Ordered failure codes of one photo; an empty array means compliant.

    ``occluded`` fails a check, phases outside the rule table are no evidence,
    a missing or NaN distance passes, a missing personal-data answer passes.
    """
    distance = F.coalesce(F.col(snap), F.lit(0.0))
    too_far = ~F.isnan(distance) & (distance > rules.MAX_SNAP_DISTANCE_M)
    is_evidence = F.coalesce(F.col(phase).isin(list(rules.PHASE_CHECKS)), F.lit(False))
    checks = []
    for position in range(2):
        for check in sorted({c[position] for c in rules.PHASE_CHECKS.values() if len(c) > position}):
            phases = [p for p, c in rules.PHASE_CHECKS.items() if len(c) > position and c[position] == check]
            failed = F.col(phase).isin(phases) & ~F.col(check).eqNullSafe("yes")
            checks.append(F.when(failed, F.concat(F.lit(check + "="), _shown(F.col(check)))))
    codes = F.array(
        F.when(~F.col(relevance).eqNullSafe("scorable"),
               F.concat(F.lit("relevance="), _shown(F.col(relevance)))),
        F.when(F.col(personal) == "yes", F.lit("personal_data_visible")),
        F.when(F.coalesce(F.col(address_flag), F.lit(False)), F.lit("latlon_vs_address_disagree")),
        F.when(F.col(assignment) == "off_cluster", F.lit("off_cluster")),
        F.when(too_far, F.concat(F.lit("snap_distance="), whole_text(distance), F.lit("m"))),
        F.when(~is_evidence, F.concat(F.lit("phase="), _shown(F.col(phase)))),
        *checks,
    )
    return F.array_compact(codes)


def photo_label(relevance: Column, personal: Column, checks: list[Column]) -> Column:
    """Label of a photo judged on its own."""
    failing = sum(F.when(c == "no", 1).otherwise(0) for c in checks)
    return (
        F.when(~relevance.eqNullSafe("scorable"), "DROP")
        .when(personal == "yes", "WITHHELD")
        .when(failing == 0, "PASS").when(failing <= 2, "WARN").otherwise("FAIL")
    )


def ela_flag(score: Column) -> Column:
    """Tamper hint, decided on the unrounded score."""
    return score > rules.ELA_THRESHOLD


def ela_score(score: Column) -> Column:
    """Stored form of the tamper score."""
    return exact_round(score, 4)


def call_cost(tokens: dict[str, Column], prices: dict[str, Column]) -> Column:
    """USD of one model call: tokens times price per million, summed in key order."""
    terms = [tokens[k] * prices[k] / F.lit(1000000.0) for k in tokens]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def uncached_input(prompt_tokens: Column, cached_tokens: Column) -> Column:
    """Input tokens billed at full price where cached ones are counted inside the prompt."""
    return F.greatest(prompt_tokens - F.coalesce(cached_tokens, F.lit(0)), F.lit(0))

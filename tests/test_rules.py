"""Scalar truth tables with every boundary."""

import random

import pytest
from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions import text
from fieldproof.functions.gate import gate_reasons, photo_label
from fieldproof.functions.numbers import exact_round, whole_text
from fieldproof.operators.coverage import coverage, with_verdict


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("digits", [2, 3, 4, 6])
def test_exact_round_equals_binary_rounding(spark, digits):
    random.seed(digits)
    numbers = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 0.0, 49.995, 17.085]
    numbers += [random.randrange(10 ** 6) / 1000 * random.choice([1, 3, 7]) for _ in range(3000)]
    got = values(spark, numbers, "double", lambda x: exact_round(x, digits))
    assert got == [round(n, digits) + 0.0 for n in numbers]


def test_whole_text_ties_to_even(spark):
    numbers = [0.5, 1.5, 2.5, 75.5, 76.5, 7.499999, 7.500001]
    assert values(spark, numbers, "double", whole_text) == [f"{n:.0f}" for n in numbers]


def test_numbers_without_decimals_or_value(spark):
    inf, nan = float("inf"), float("nan")
    assert [str(x) for x in values(spark, [nan, inf, -inf, 1e17, -1e300], "double", lambda x: exact_round(x, 2))] == [
        "nan", "inf", "-inf", "1e+17", "-1e+300"]
    assert values(spark, [nan, inf, -inf, 1e17], "double", whole_text) == ["nan", "inf", "-inf", "1" + "0" * 17]


def test_overlay_coordinates(spark):
    cases = {
        "46°33'56.226\"N 14°17'15,39\"E": (46 + 33 / 60 + 56.226 / 3600, 14 + 17 / 60 + 15.39 / 3600),
        "46.56153856N 14.28786228E": (46.56153856, 14.28786228),
        "Lat 46.55, Long 14.29": (46.55, 14.29),
        "latitude: 46,55 longitude=-14,29": (46.55, -14.29),
        "14.5W 46.5S": (-46.5, -14.5),
        "446.33N 14.2E": None,
        "446°10'10\"N 14°10'10\"E Lat 46.5 Long 14.5": (46.5, 14.5),
        "GPS unavailable": None, "46°33'56\"N": None, "46.1N 47.2N": None, "": None,
    }
    got = values(spark, [*cases, None], "string", text.overlay_coordinates)
    assert [None if g is None else (g.lat, g.lon) for g in got] == [*cases.values(), None]


def test_labels_streets_and_ids(spark):
    labels = values(spark, ["F170-R084-11-or", "f012 x r003", "F170 only", "F1700-R084", None], "string", text.paper_label)
    assert [l and (l.f_code, l.r_code) for l in labels] == [("F170", "R084"), ("F012", "R003"), None, None, None]
    assert [sorted(v) for v in values(spark, ["F:r008^R082", "", None], "string", text.r_code_tokens)] == [["F", "R008", "R082"], [], []]
    pairs = [("1 Fasanstraße", "Fasanstrasse"), ("Hauptstrasse 3", "Haupt 4"), ("", "x"), ("Göltweg", "Goltweg 2"), ("Ab", "Cd")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.d for r in df.select("i", text.streets_disagree(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [True, False, False, False, False]
    names = ["12_IMG.JPG", "IMG - копия (2).jpg", "7_Foto - КОПИЯ.png", ".jpg", "a.b.jpeg"]
    assert values(spark, names, "string", text.family_key) == ["img", "img", "foto", ".jpg", "a.b"]


def test_action_text(spark):
    cases = {
        "": rules.EMPTY_REASONS_TEXT,
        "3x warning_tape_visible=no": "(3 photos) " + rules.PATTERN_ACTIONS[10][1],
        "off_cluster; phase=depth_measure":
            rules.FIXED_ACTIONS["off_cluster"] + " Re-shoot — the photo at the depth-measuring stage showed no trench evidence.",
        "max gap 31m > 5m between meter 2 and meter 33":
            "Re-shoot one photo every 5 m between meter 2 and meter 33 (currently a 31 m gap).",
        "tape_laid phase but orange tape not visible": "Re-shoot one photo showing the orange tape, during the tape-laying stage.",
        " ; ": "",
    }
    assert values(spark, list(cases), "string", text.action_text) == list(cases.values())


def test_redaction_and_scrub(spark):
    got = values(spark, ["x Authorization: abc\nmore", "a" * 400, "sk-ant-1 x-api-key"], "string", text.redact_secrets)
    assert got == ["x [Authorization redacted]", "a" * 300, "[sk-ant- redacted]"]
    assert values(spark, ["<a>\x07" + "b" * 600], "string", text.scrub) == ["&lt;a&gt;" + "b" * 491 + "…"]


BASE = dict(
    relevance="scorable", personal_data_visible="no", latlon_vs_address_flag=False, fcp_assignment="inside_polygon",
    snap_distance_m=1.0, phase="backfilled", side_view_present="yes", depth_reference_visible="yes", duct_visible="yes",
    sand_bedding_visible="yes", warning_tape_visible="yes",
)
GATE = [
    ({}, []), ({"relevance": None}, ["relevance=None"]), ({"personal_data_visible": "yes"}, ["personal_data_visible"]),
    ({"personal_data_visible": None}, []), ({"snap_distance_m": 75.0}, []), ({"snap_distance_m": 75.1}, ["snap_distance=75m"]),
    ({"snap_distance_m": 76.5}, ["snap_distance=76m"]), ({"snap_distance_m": None}, []), ({"snap_distance_m": float("nan")}, []),
    ({"phase": None}, ["phase=None"]), ({"phase": "staging"}, ["phase=staging"]),
    ({"phase": "depth_measure", "side_view_present": "no", "depth_reference_visible": "no"},
     ["depth_reference_visible=no", "side_view_present=no"]),
    ({"phase": "sand_bedded", "duct_visible": "occluded", "sand_bedding_visible": None},
     ["sand_bedding_visible=None", "duct_visible=occluded"]),
    ({"phase": "tape_laid", "warning_tape_visible": "occluded", "fcp_assignment": "off_cluster", "latlon_vs_address_flag": True},
     ["latlon_vs_address_disagree", "off_cluster", "warning_tape_visible=occluded"]),
]


def test_gate(spark):
    kinds = {"latlon_vs_address_flag": "boolean", "snap_distance_m": "double"}
    schema = "i int, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in BASE)
    df = spark.createDataFrame([(i, *{**BASE, **change}.values()) for i, (change, _) in enumerate(GATE)], schema)
    got = [r.y for r in df.select("i", gate_reasons().alias("y")).orderBy("i").collect()]
    assert got == [reasons for _, reasons in GATE]


def test_photo_label(spark):
    rows = [("scorable", "no", n) for n in range(4)] + [("scorable", "yes", 0), ("portrait", "yes", 0), (None, "no", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, p string, n int")
    checks = [F.when(F.col("n") > k, "no").otherwise("occluded") for k in range(6)]
    got = [r.y for r in df.select("i", photo_label(F.col("r"), F.col("p"), checks).alias("y")).orderBy("i").collect()]
    assert got == ["PASS", "WARN", "WARN", "FAIL", "WITHHELD", "DROP", "DROP"]


VERDICTS = [
    (3.0, [], "RED", 3.0, "no compliant photos snapped"), (5.0, [0.5], "GREEN", 0.0, None),
    (10.0, [0.5], "GREEN", 5.0, None), (10.1, [0.5], "RED", 5.05, "density 1/10m below 1/10m"),
    (10.0, [0.0, 0.5, 1.0], "GREEN", 5.0, None), (8.0, [0.75], "YELLOW", 6.0, "first compliant photo at meter 6 (>5m from start)"),
    (8.0, [0.25], "YELLOW", 6.0, "last compliant photo at meter 2 (>5m from end of 8m)"),
    (20.0, [0.1, 0.5, 0.9], "YELLOW", 8.0, "max gap 8m > 5m between meter 2 and meter 10"),
]


def test_verdict_rule(spark):
    rows = [(i, length, len(p), p) for i, (length, p, *_) in enumerate(VERDICTS)]
    df = spark.createDataFrame(rows, "segment_id int, length_m double, compliant_photo_count long, positions array<double>")
    got = [(r.verdict, r.raw_gap_m, r.gap_reason) for r in with_verdict(df).orderBy("segment_id").collect()]
    assert got == [v[2:] for v in VERDICTS]


def test_result_does_not_depend_on_row_order(spark):
    from compare import DATA

    from fieldproof.plans import tables as t

    photos, segments = t.photos(spark, f"{DATA}/sf0.001"), t.segments(spark, f"{DATA}/sf0.001")
    shuffled = photos.repartition(7, F.rand(3)).orderBy(F.rand(5))
    assert sorted(coverage(photos, segments).collect()) == sorted(coverage(shuffled, segments).collect())

"""Exactness of the spatial and similarity joins against brute force, and under skew."""

import math
import random

from pyspark.sql import functions as F

from fieldproof.operators import audit, components, similarity, spatial
from fieldproof.operators.coverage import dedup_entries, rollup
from fieldproof.operators.budget import within_budget


def brute_nearest(point, edges):
    def distance(e):
        _, order, number, x1, y1, x2, y2 = e
        dx, dy = x2 - x1, y2 - y1
        share = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((point[1] - x1) * dx + (point[2] - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(point[1] - x1 - share * dx, point[2] - y1 - share * dy)

    return min((round(distance(e), 6), e[1], e[2]) for e in edges if e[0] == point[0])


def test_nearest_edge_is_exact_at_every_distance(spark):
    random.seed(4)
    edges = []
    for i in range(60):
        x, y, length = random.uniform(0, 4000), random.uniform(0, 4000), random.choice([3, 40, 900])
        a = random.uniform(0, 6.28)
        edges.append(("ab"[i % 2], i, 0, x, y, x + length * math.cos(a), y + length * math.sin(a)))
    reach = [5, 100, 2000, 50000, 3000000]
    points = [("ab"[i % 2], *(random.uniform(-r, 4000 + r) for r in [random.choice(reach)] * 2)) for i in range(250)]
    edge_df = spark.createDataFrame(edges, "grp string, ord int, edge_no int, x1 double, y1 double, x2 double, y2 double").withColumns(
        {"offset": F.lit(0.0), "line_length": F.lit(1.0)})
    point_df = spark.createDataFrame([*points, ("a", float("nan"), 1.0)], "grp string, px double, py double")
    got = {(r.grp, r.px, r.py): (round(r.distance, 6), r.ord) for r in spatial.nearest_edge(point_df, edge_df).collect()}
    assert got == {p: brute_nearest(p, edges)[:2] for p in points}


def test_hot_position_is_searched_once(spark):
    edges = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 10.0, 0.0, 0.0, 10.0)],
                                  "grp string, ord int, edge_no int, x1 double, y1 double, x2 double, y2 double, offset double, line_length double")
    points = spark.range(3000).select(F.lit("a").alias("grp"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7).alias("px"), F.lit(3.0).alias("py"))
    hits = spatial.nearest_edge(points, edges)
    assert hits.count() == points.distinct().count()


def test_containment_with_hole_overlap_and_order(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    hole = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
    zones = spark.createDataFrame([(1, [square, hole]), (2, [square])], "zone_order int, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (20.0, 5.0)], "px double, py double")
    got = {(r.px, r.py): r.zone_order for r in spatial.containing_zone(points, zones).collect()}
    assert got == {(1.0, 1.0): 1, (5.0, 5.0): 2}


def test_similarity_refines_hot_buckets_exactly(spark):
    random.seed(1)
    found = set()
    for base in [random.getrandbits(64) for _ in range(60)]:
        for _ in range(5):
            value = base
            for _ in range(random.randint(0, 7)):
                value ^= 1 << random.randrange(64)
            found.add(value)
    for _ in range(200):  # nearly all bits equal: every key bucket is hot
        found.add(0xABCDEF0123400000 ^ random.getrandbits(11))
    hashes = [v - (1 << 64) if v >> 63 else v for v in found]
    mask = (1 << 64) - 1
    expected = {(min(a, b), max(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1:] if ((a ^ b) & mask).bit_count() <= 6}
    df = spark.createDataFrame([(v,) for v in hashes], "h long")
    for limit in (10 ** 6, 100):
        pairs = [(r.a_fp, r.b_fp) for r in similarity.similar_fingerprints(df, bucket_limit=limit).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_similarity_of_few_and_many_values(spark):
    """The block count follows the size; what is found does not."""
    random.seed(2)
    values = [0, -1, 1 << 62] + [random.getrandbits(63) for _ in range(60)]
    values += [v ^ 0b1011 for v in values[:20]] + [v ^ 0b1111110 for v in values[20:30]] + [v ^ 0b1111111 for v in values[30:40]]
    mask, values = (1 << 64) - 1, sorted(set(values))
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & mask).bit_count() <= 6}
    df = spark.createDataFrame([(v,) for v in values], "h long")
    for blocks in (2, 3, 4, 7):
        chosen, similarity.choose_blocks = similarity.choose_blocks, lambda n, threshold, b=blocks: b
        try:
            found = [(r.a_fp, r.b_fp) for r in similarity.similar_fingerprints(df).collect()]
        finally:
            similarity.choose_blocks = chosen
        assert sorted(found) == sorted(want)
    assert similarity.choose_blocks(2000, 6) != similarity.choose_blocks(10 ** 8, 6)


def test_crowd_of_near_equal_fingerprints_needs_no_pairs(spark):
    """A hundred thousand values that differ in seventeen bits: stars join them, and no pair is left to compare."""
    crowd = spark.range(100_000).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 17) - 1)) + F.lit(7 << 40)).alias("h")).distinct()
    lone = spark.createDataFrame([((7 << 40) + (1 << 50) + (1 << 51) + 5,), (-1,)], "h long")
    photos = crowd.unionByName(lone).select(F.format_string("p%d", "h").alias("photo_id"), F.col("h").alias("phash"))
    n = crowd.count()
    stars = similarity.close_groups(crowd)
    assert stars.count() < 60 * n
    sizes = sorted(r.members for r in components.cluster_sizes(components.cluster_photos(photos)).collect())
    assert sizes == [1, n + 1]


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    hub = [(1000, i) for i in range(1001, 1400)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{i: 1000 for i in range(1000, 1400)}}


def test_identical_copies_form_one_cluster(spark):
    photos = spark.range(900).select(
        F.format_string("p%04d", "id").alias("photo_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("phash"))
    clustered = components.cluster_photos(photos)
    assert clustered.count() == 900
    top = components.largest_clusters(clustered, 1).first()
    assert (top.cluster_id, top.members) == ("p0000", 300)


def test_hot_segment_is_whole(spark):
    photos = spark.range(6000).select(
        F.format_string("p%05d", "id").alias("photo_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("segment_id"),
        (F.col("id") % 10000 / 10000).alias("segment_t"), (F.floor(F.col("id") / 2)).alias("cluster_id"), F.lit(False).alias("is_representative"),
        F.array().cast("array<string>").alias("reasons"), F.lit(True).alias("compliant"))
    rolled = {r.segment_id: (r.photo_count, len(r.positions)) for r in rollup(dedup_entries(photos)).collect()}
    assert rolled["hot"] == (2000, 2000) and len(rolled) == 51


def test_budget_equals_running_sum(spark):
    work = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("photo_id"), (F.col("id") % 97).alias("cost_nano"))
    spent, expected = 0, []
    for r in work.orderBy("photo_id").collect():
        if spent <= 70000:
            expected.append(r.photo_id)
        spent += r.cost_nano
    assert sorted(r.photo_id for r in within_budget(work, 70000).collect()) == expected


def test_budget_takes_any_key_and_repeated_keys(spark):
    rows = [(None if i % 50 == 0 else i // 7 - 20, i % 13) for i in range(3000)] + [(999, 3)] * 1500
    work = spark.createDataFrame(rows, "k int, cost long").repartition(5)
    kept = within_budget(work, 9000, "cost", "k").collect()
    spent, want = 0, []
    for key, cost in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if spent <= 9000:
            want.append((key, cost, spent))
        spent += cost
    assert sorted((r.k, r.cost, r.spent_before) for r in kept if r.k is not None) == sorted(w for w in want if w[0] is not None)
    assert len(kept) == len(want)


def test_one_stage_with_a_whole_log_in_a_day_is_split(spark):
    random.seed(11)
    rows = [(i, f"2026-01-01 00:{i // 600 % 60:02d}:{i // 10 % 60:02d}", "one" if i % 9 else "two", random.choice(["stage_start", "stage_end", "other"]),
             random.choice(["m", None, ""]), i) for i in range(5000)]
    events = spark.createDataFrame(rows, "event_id long, t string, stage string, event string, model string, elapsed long").withColumn("ts", F.to_timestamp("t"))
    got = sorted((r.stage, r.start_id, r.end_id) for r in audit.stage_runs(events).collect())
    want, last = [], {}
    for i, _, stage, event, model, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if event == "other":
            continue
        before = last.get(stage)
        if event == "stage_end" and before and before[0] == "stage_start" and before[2]:
            want.append((stage, before[1], i))
        last[stage] = (event, i, model)
    assert got == sorted(want)

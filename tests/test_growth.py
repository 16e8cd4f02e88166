"""What must not grow with the tables: what the driver collects, what one task reads, what joins move."""

import os

import pytest
from pyspark.sql import functions as F

from compare import DATA
from fieldproof.operators import chain, locate, manifest
from fieldproof.plans import identity_queries, live_queries, place_queries, tables
from fieldproof.session import cut_lineage, dropped_steps, measured_broadcasts, released_shuffles, scratch_path

SF = f"{DATA}/sf0.001"
PLANNED, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_estimates_broadcast_nothing_while_a_stage_is_built(spark, monkeypatch):
    """an exploded table was collected by the driver because its file is small."""
    seen, hashed = [], manifest.with_content_id
    monkeypatch.setattr(manifest, "with_content_id", lambda files: seen.append((spark.conf.get(PLANNED), spark.conf.get(ADAPTIVE))) or hashed(files))
    limit = spark.conf.get(PLANNED)
    files = spark.createDataFrame([("a.jpg", "x/a.jpg", 1, 1, "a")], "filename string, rel_path string, bytes long, mtime long, content string")
    tables_of, _ = chain.run(spark, scratch_path(spark, "wanted"), chain.Sources(files, *[None] * 6), ("manifest",))
    assert seen == [("-1", limit)] and tables_of["manifest"].count() == 1
    assert spark.conf.get(PLANNED) == limit and spark.conf.get(ADAPTIVE, None) is None


def test_estimates_broadcast_nothing_while_photos_are_located(spark, monkeypatch):
    """the cells of all zones, 345 MB of 12,000 zones, were collected by the driver because the parts' file is small."""
    seen, located, tagged, limit = [], locate.locate_photos, place_queries.tagged_lines, spark.conf.get(PLANNED)
    for module, name, step in ((locate, "locate_photos", located), (place_queries, "tagged_lines", tagged)):
        monkeypatch.setattr(module, name, lambda *given, step=step: seen.append((spark.conf.get(PLANNED), spark.conf.get(ADAPTIVE))) or step(*given))
    rows = place_queries.located_photos(spark, SF)
    assert seen == [("-1", limit)] * 2 and spark.conf.get(PLANNED) == limit
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == tables.stamps(spark, SF).count()


def test_measured_broadcasts_nest_and_come_back_after_an_error(spark):
    limit = spark.conf.get(PLANNED)
    with pytest.raises(ValueError), measured_broadcasts(spark):
        with measured_broadcasts(spark):
            assert (spark.conf.get(PLANNED), spark.conf.get(ADAPTIVE)) == ("-1", limit)
        wide = spark.range(4).select("id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("n"))
        assert "BroadcastHashJoin" not in wide.join(spark.range(4), "id")._jdf.queryExecution().sparkPlan().toString()
        raise ValueError
    assert spark.conf.get(PLANNED) == limit and spark.conf.get(ADAPTIVE, None) is None


def test_late_photos_come_in_three_batches_of_any_number_of_files(spark, monkeypatch):
    """each batch was one file, so one task read all photos."""
    def refuse(*_):
        raise AssertionError("one task for all rows")

    batches, apply = [], live_queries.incremental.VerdictStore.apply
    monkeypatch.setattr(type(spark.range(1)), "coalesce", refuse)
    monkeypatch.setattr(live_queries.incremental.VerdictStore, "apply", lambda store, rows, batch: batches.append(batch) or apply(store, rows, batch))
    rows = live_queries.streamed_verdicts(spark, SF)
    assert batches == [0, 1, 2] and rows.count() == tables.segments(spark, SF).count()


def test_a_stage_leaves_its_table_and_no_steps_or_shuffles(spark):
    """every step and shuffle of all stages stayed on disk until the end of the run."""
    cleanup, steps, kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], cut_lineage(spark.range(3))
    before = spark.conf.get(cleanup, None)

    def build():
        steps.extend([(spark.conf.get(cleanup), cut_lineage(spark.range(40).repartition(3)).groupBy("id").count())])
        return steps[0][1].join(cut_lineage(kept), "id")

    table = chain.StageTables(spark, scratch_path(spark, "stage"), {"x": "1"}).table("t", ("x",), build)
    assert table.count() == 3 and kept.count() == 3 and steps[0][0] == "true" and spark.conf.get(cleanup, None) == before
    folders = {f.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") for f in steps[0][1].inputFiles()}
    assert len(folders) == 1 and not os.path.exists(folders.pop())
    with pytest.raises(ValueError), dropped_steps(spark), released_shuffles(spark):
        path = scratch_path(spark, "failed")
        spark.range(1).write.parquet(path)
        raise ValueError
    assert not os.path.exists(path.removeprefix("file://")) and spark.conf.get(cleanup, None) == before
    assert os.path.exists(scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://"))


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [tables.forensics, tables.quality])
def test_clusters_of_photos_need_no_join(spark, rows):
    """Ids were joined back to their own photos; now the raw rows move once."""
    plan = rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "sha1" not in plan.split("Exchange")[1]


def test_inheriting_quality_moves_only_the_fields_that_are_read(spark):
    photos = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 1, False), ("d", 2, False)], "photo_id string, cluster_id int, is_representative boolean")
    quality = spark.createDataFrame([("a", "p", "long"), ("b", None, "long")], "photo_id string, phase string, note string")
    known = locate.effective_quality(photos, quality)
    rows = {r.photo_id: (r.duplicate_of, r.phase, r.note) for r in known.collect()}
    # b has a row of its own, so its missing phase stays missing; d has neither.
    assert rows == {"a": (None, "p", "long"), "b": (None, None, "long"), "c": ("a", "p", "long")}
    steps = [s for s in _plan(known.select("photo_id", "duplicate_of", "phase")).splitlines() if "LogicalRDD" not in s]
    assert not any("note#" in s for s in steps)


def test_inherited_places_and_pending_photos_join_no_table_twice_as_often_as_needed(spark):
    """scored, others and their place; representatives and scores."""
    assert _plan(identity_queries.inherited_locations(spark, SF)).count("Join ") == 3
    assert _plan(identity_queries.pending_photos(spark, SF)).count("Join ") == 2

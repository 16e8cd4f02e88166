"""Files, archives and replayed batches."""

import hashlib
import io
import json
import tarfile
import zipfile

from compare import DATA
from pyspark.sql import functions as F

from fieldproof.operators import manifest
from fieldproof.operators.coverage import coverage
from fieldproof.plans import source_queries
from fieldproof.plans import tables as t
from fieldproof.session import scratch_path
from fieldproof.sources import archives, features, files
from fieldproof.streaming.incremental import VerdictStore, with_uploads


def test_photo_folder_to_manifest(spark, tmp_path):
    for name, data in [("b.JPG", b"one"), ("a.jpeg", b"one"), ("c.heic", b"two"), ("note.txt", b"x"), (".png", b"hidden")]:
        (tmp_path / name).write_bytes(data)
    rows = manifest.with_content_id(files.scan_files(spark, str(tmp_path))).drop("content", "path")
    kept = {r.photo_id: r.filename for r in manifest.first_occurrences(rows).collect()}
    assert kept == {hashlib.sha1(b"one").hexdigest(): "a.jpeg", hashlib.sha1(b"two").hexdigest(): "c.heic"}
    assert [r.copies for r in manifest.skipped_copies(rows).collect()] == [1]


def test_features_under_both_spellings(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[14.0, 46.0], [14.1, 46.1]]}
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    collection = {"type": "FeatureCollection", "features": [
        {"properties": {"externalID": "A", "isConnectedToHome": True}, "geometry": line},
        {"properties": {"globalID": "B", "fcpName": "F001"}, "geometry": line},
        {"properties": {"kmlDescriptionSimple": "F012 [81]"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "x.geojson").write_text(json.dumps(collection, indent=1))
    rows = features.read_features(spark, str(tmp_path / "x.geojson"))
    assert [(r.segment_id, r.fcp_name, r.is_connected_to_home, len(r.coords)) for r in features.lines(rows).orderBy("feature_no").collect()] == [
        ("A", None, True, 2), ("B", "F001", None, 2)]
    assert [(r.fcp_name, len(r.rings)) for r in features.polygons(rows).orderBy("feature_no").collect()] == [("F012", 1), (None, 2)]


def test_json_rejects_are_kept_aside(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2, broken\n{"a": 3}\n')
    schema = spark.createDataFrame([], "a long").schema
    assert [r.a for r in files.read_json_rows(spark, str(tmp_path), schema).orderBy("a").collect()] == [1, 3]
    assert [r.line for r in files.read_json_rejects(spark, str(tmp_path), schema).collect()] == ['{"a": 2, broken']


def test_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as archive:
        info = tarfile.TarInfo("d/p.png")
        info.size = 3
        archive.addfile(info, io.BytesIO(b"abc"))
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as archive:
        for i in range(501):
            archive.writestr(f"{i}.jpg", "x")
    rows = spark.createDataFrame(
        [("a.tar.gz", tar.getvalue()), ("m.zip", many.getvalue()), ("bad.tgz", b"no"), ("solo.jpg", b"z")], "archive string, content binary")
    found = archives.expand_archives(rows)
    assert [(r.archive, r.n) for r in found.filter("error IS NULL").groupBy("archive").agg(F.count("*").alias("n")).orderBy("archive").collect()] == [
        ("a.tar.gz", 1), ("m.zip", 501), ("solo.jpg", 1)]
    errors = {r.archive: r.error for r in found.filter("error IS NOT NULL").collect()}
    assert list(errors) == ["bad.tgz"] and errors["bad.tgz"].startswith("corrupt archive")
    limited = archives.expand_archives(rows.filter("archive = 'm.zip'"), most_members=499)
    assert [r.error for r in limited.filter("error IS NOT NULL").collect()] == ["member limit reached"] * 2


def _damaged():
    """The same zip of three members with the first one broken and with it marked as encrypted."""
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in "abc":
            archive.writestr(f"{name}.jpg", name * 300)
    broken, encrypted = bytearray(whole.getvalue()), bytearray(whole.getvalue())
    broken[broken.find(b"a.jpg") + 5] ^= 0xFF
    encrypted[encrypted.find(b"PK\x01\x02") + 8] |= 1
    encrypted[6] |= 1
    return bytes(broken), bytes(encrypted)


def test_one_bad_member_leaves_the_others(spark):
    broken, encrypted = _damaged()
    rows = spark.createDataFrame([("b.zip", broken), ("e.zip", encrypted)], "archive string, content binary")
    found = archives.expand_archives(rows).collect()
    assert sorted((r.archive, r.member) for r in found if r.error is None) == [
        (f"{a}.zip", f"{a}.zip/{m}.jpg") for a in "be" for m in "bc"]
    assert all(r.error.startswith("unreadable member") for r in found if r.member.endswith("a.jpg"))


def test_nested_zip_gives_all_its_geo_files(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as archive:
        archive.writestr("x_trenches.geojson", "{}")
        archive.writestr("x_fcp_polygons.geojson", "{}")
    with zipfile.ZipFile(outer, "w") as archive:
        archive.writestr("lot_trenches.geojson", "{}")
        archive.writestr("all_geojson.zip", inner.getvalue())
    rows = spark.createDataFrame([("lot.zip", outer.getvalue())], "archive string, content binary")
    assert sorted((r.tag, r.member) for r in archives.open_bundles(rows).collect()) == [
        ("fcps", "x_fcp_polygons.geojson"), ("trenches", "lot_trenches.geojson")]


def test_replayed_batch_leaves_the_same_state(spark):
    sf = f"{DATA}/sf0.001"
    photos, segments = t.photos(spark, sf), t.segments(spark, sf)
    store = VerdictStore(spark, scratch_path(spark, "replay"), segments)
    store.bootstrap(t.early(photos))
    late = t.late(photos)
    first, second = late.filter("k % 2 = 0"), late.filter("k % 2 = 1")
    store.apply(first, 0)
    store.apply(second, 1)
    once = sorted(store.current().collect())
    store.apply(second, 1)
    assert sorted(store.current().collect()) == once
    batch = coverage(with_uploads(t.early(photos), late), segments)
    assert once == sorted(batch.collect())


def test_every_row_is_a_file_of_its_own_and_files_are_dealt_by_size(spark, tmp_path):
    """Rows that repeat an id, empty and missing texts are files too; a task gets hundreds of small files."""
    rows = [(n, f"text {n}") for n in range(1500)] + [(7, "again"), (8, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = source_queries.photo_file_scan(spark, str(tmp_path)).collect()
    want = [(d, len(x or "") + 1, hashlib.sha1(((x or "") + "\n").encode()).hexdigest()) for d, x in rows]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    for n in range(1200):
        (tmp_path / f"{n}.jpg").write_bytes(b"x")
    with files.packed_by_size(spark):
        assert files.scan_files(spark, str(tmp_path)).rdd.getNumPartitions() < 12


def test_folders_are_listed_and_read_by_tasks_like_sparks_own_scan(spark, tmp_path, monkeypatch):
    """the driver listed every file, and Spark's reader took most of a millisecond for each small one."""
    for at, name in enumerate(["a.JPG", "lot 1/b.jpeg", "lot 1/deep/ß.jpg", "lot 1/deep/note.txt", "_tmp/c.jpg", "k=_1/d.jpg", "_k=1/e.jpg", ".hidden/f.jpg", "lot 2/.g.jpg", "lot 2/_h.jpg", "lot 2/.jpg", "lot 2/i.jpg.part", "lot 2/empty.jpg"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5000 * (at + 1) if "empty" not in name else b"")
    (tmp_path / "lot 3").mkdir()
    monkeypatch.setattr(files, "READ_AT_ONCE", 6000)
    mounted = files.scan_files(spark, f"file://{tmp_path}")
    monkeypatch.setattr(files.os.path, "isdir", lambda _: False)
    sparks = files.scan_files(spark, f"file://{tmp_path}")
    assert mounted.schema.simpleString() == sparks.schema.simpleString()
    got, want = (sorted(map(tuple, f.collect())) for f in (mounted, sparks))
    assert got == want and sorted(r[2] for r in got) == ["_k=1/e.jpg", "a.JPG", "k=_1/d.jpg", "lot 1/b.jpeg", "lot 1/deep/ß.jpg"]
    assert "binaryFile" not in mounted._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    assert files.scan_files(spark, str(tmp_path / "lot 3")).count() == 0 and mounted.select("rel_path").count() == 5

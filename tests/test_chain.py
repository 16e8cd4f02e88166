"""The batch chain: stages are resumed, sources rebuild what reads them, banners and places agree."""

from pyspark.sql import functions as F

from compare import DATA
from fieldproof.functions import geo
from fieldproof.functions.text import phash_bits
from fieldproof.operators import chain, locate
from fieldproof.plans import chain_queries, tables
from fieldproof.session import scratch_path

SF = f"{DATA}/sf0.001"


def test_chain_resumes_by_stage_and_source(spark):
    root, given = scratch_path(spark, "chain-test"), chain_queries.sources(spark, SF)
    tables_of, stages = chain.run(spark, root, given)
    assert len(stages.built) == 16
    first = sorted(map(str, tables_of["verdicts"].collect()))
    again, resumed = chain.run(spark, root, given)
    assert resumed.built == [] and sorted(map(str, again["verdicts"].collect())) == first
    other, changed = chain.run(spark, root, chain.Sources(**{**vars(given), "cache": given.cache.limit(0), "versions": {"cache": "none"}}))
    assert changed.built == ["located", "geomatch", "judged", "verdicts", "deficiencies", "events"]
    assert other["located"].filter("coord_source = 'geocoded_address'").isEmpty()
    banners = changed.banners()
    ends = {r.stage: r.counters for r in banners.filter("event = 'stage_end'").orderBy("ts").collect()}
    assert banners.filter("event = 'stage_start'").count() == 22 == banners.filter("event = 'stage_end'").count()
    assert ends["verdicts"]["rows"] == sum(ends["verdicts"][v] for v in ("red", "yellow", "green")) == other["verdicts"].count()
    assert ends["located"]["none"] == other["located"].filter("coord_source = 'none'").count()


def test_members_take_their_own_place_then_the_representatives(spark):
    located = spark.createDataFrame([("b", "s1"), ("c", "s2"), ("x", "s3"), ("m", "s4"), ("n", "s5")], "photo_id string, segment_id string")
    clusters = spark.createDataFrame(
        [("a", 1, False), ("b", 1, False), ("c", 1, True), ("d", 1, False), ("m", 2, False), ("n", 2, False), ("o", 2, True)], "photo_id string, cluster_id int, is_representative boolean")
    got = {r.photo_id: r.segment_id for r in locate.inherit_locations(located, clusters).collect()}
    assert got == {"a": "s2", "b": "s1", "c": "s2", "d": "s2", "m": "s4", "n": "s5", "o": "s4", "x": "s3"}


def test_features_of_all_files_have_one_order(spark):
    frame = chain_queries.sources(spark, SF).lines
    places = chain.features.in_file_order(frame).select("segment_id", "place").collect()
    assert len({str(r.place) for r in places}) == len(places)
    ordered = [int(r.segment_id.split("_")[1]) for r in sorted(places, key=lambda r: tuple(r.place))]
    assert ordered == sorted(ordered)


def test_fingerprint_text_to_bits(spark):
    texts = {"ffffffffffffffff": -1, "8000000000000000": -(1 << 63), "7fffffffffffffff": (1 << 63) - 1, "00000000000000AB": 171, "": None, "xyz": None, "fff": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", phash_bits(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == texts


def meridian_arc(lat: float) -> float:
    """Length from the equator along the ellipsoid, by Simpson's rule."""
    from math import radians, sin

    e2, n = (2 - 1 / 298.257223563) / 298.257223563, 4000
    f = lambda phi: 6378137 * (1 - e2) / (1 - e2 * sin(phi) ** 2) ** 1.5
    h = radians(lat) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1))


def test_projection_is_conformal_and_true_on_the_meridian(spark):
    """These two facts fix the projection: arcs of the central meridian, and equal scale in both directions everywhere."""
    e2, step = (2 - 1 / 298.257223563) / 298.257223563, 1e-5
    grid = [(float(lon), float(lat)) for lon in (-15, 0, 14.3, 15, 30) for lat in (-80, -46.2, 0, 46.5, 80)]
    points = [(lon + a, lat + b) for lon, lat in grid for a, b in ((0, 0), (step, 0), (-step, 0), (0, step), (0, -step))]
    frame = spark.createDataFrame(points, "lon double, lat double")
    east, north = geo.utm33(F.col("lon"), F.col("lat"))
    at = {(r.lon, r.lat): (r.e, r.n) for r in frame.select("lon", "lat", east.alias("e"), north.alias("n")).collect()}
    from math import cos, radians, sin

    for lon, lat in grid:
        e, n = at[(lon, lat)]
        if lon == 15:
            assert abs(e - 500_000) < 1e-6 and abs(n - 0.9996 * meridian_arc(lat)) < 1e-5
        w = 1 - e2 * sin(radians(lat)) ** 2
        metres = (6378137 / w ** 0.5 * cos(radians(lat)), 6378137 * (1 - e2) / w ** 1.5)
        by_lon = [(b - a) / metres[0] for a, b in zip(at[(lon - step, lat)], at[(lon + step, lat)])]
        by_lat = [(b - a) / metres[1] for a, b in zip(at[(lon, lat - step)], at[(lon, lat + step)])]
        assert abs(by_lon[0] - by_lat[1]) < 1e-9 and abs(by_lon[1] + by_lat[0]) < 1e-9


def test_derived_sources_hold_every_case(spark):
    scores = tables.field_scores(spark, f"{DATA}/sf0.01")
    assert scores.filter("overlay_latlon IS NULL").count() and scores.filter("overlay_address = ''").count()
    prints = tables.field_fingerprints(spark, f"{DATA}/sf0.01").select(phash_bits(F.col("phash")).alias("b"))
    assert prints.filter("b < 0").count() and prints.filter("b IS NULL").count()


def test_stages_that_nothing_wanted_reads_are_not_built(spark):
    """Locations need no verdicts and no reports; a manifest needs the files alone (F1, F2)."""
    assert chain.needed(("geomatch",)).isdisjoint({"pending", "judged", "verdicts", "deficiencies", "not_classified", "personal_data", "events"})
    assert chain.needed(tuple(chain.READS)) == set(chain.READS)
    files = spark.createDataFrame([("a.jpg", "x/a.jpg", 1, 1, "a"), ("b.jpg", "x/b.jpg", 1, 2, "a")], "filename string, rel_path string, bytes long, mtime long, content string")
    given = chain.Sources(files, *[None] * 6)
    tables, stages = chain.run(spark, scratch_path(spark, "wanted"), given, ("manifest",))
    assert list(tables) == ["manifest"] and stages.built == ["hashed", "manifest"] and tables["manifest"].count() == 1

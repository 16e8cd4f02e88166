"""Coordinates, zones, snapping and cross-checks."""

from pyspark.sql import functions as F

from fieldproof.functions import geo
from fieldproof.functions.numbers import exact_round
from fieldproof.functions.text import overlay_coordinates
from fieldproof.operators import locate, mapsets, spatial
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query, scaled, scaled_sql
from fieldproof.plans.oracle_views import planar_sql, rounded, tokens_sql
from fieldproof.session import cut_lineage, measured_broadcasts, released_shuffles


def tagged_lines(spark, sf):
    return spatial.tag_lines(t.network(spark, sf), t.zones(spark, sf))


def assigned(spark, sf):
    return spatial.assign_zone(t.points(spark, sf), t.zones(spark, sf), t.site(spark, sf))


def resolved(spark, sf):
    return locate.resolve_coordinates(t.stamps(spark, sf), t.geocode_cache(spark, sf))


_HALF = "sin(radians({b} - {a}) / 2) * sin(radians({b} - {a}) / 2)"


def _haversine_sql(lat1, lon1, lat2, lon2):
    a = f"{_HALF.format(a=lat1, b=lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {_HALF.format(a=lon1, b=lon2)}"
    return f"12742000::DOUBLE * asin(sqrt({a}))"


@query("P10", f"""SELECT photo_id, {scaled_sql(_haversine_sql('lat', 'lon', '46.56', '14.28'), 2)} AS distance_cm
FROM read_stamps WHERE lat IS NOT NULL""")
def haversine_distances(spark, sf):
    rows = t.stamps(spark, sf).withColumn("at", geo_at()).filter("at IS NOT NULL")
    distance = geo.haversine_m(F.col("at.lat"), F.col("at.lon"), F.lit(46.56), F.lit(14.28))
    return rows.select("photo_id", scaled(distance, 2).alias("distance_cm"))


def geo_at():
    return overlay_coordinates(F.col("overlay_latlon"))


@query("P11", f"""SELECT photo_id, {scaled_sql('east', 3)} AS east_mm, {scaled_sql('north', 3)} AS north_mm
FROM ({planar_sql('(SELECT photo_id, lat, lon FROM read_stamps WHERE lat IS NOT NULL)', 'photo_id')})""")
def utm_positions(spark, sf):
    rows = t.stamps(spark, sf).withColumn("at", geo_at()).filter("at IS NOT NULL")
    east, north = geo.utm33(F.col("at.lon"), F.col("at.lat"))
    return rows.select("photo_id", scaled(east, 3).alias("east_mm"), scaled(north, 3).alias("north_mm"))


@query("P12", f"""SELECT segment_id, {scaled_sql('l1 + l2', 6)} AS length_um, {scaled_sql('px', 6)} AS mid_x_um, {scaled_sql('py', 6)} AS mid_y_um FROM (
  SELECT segment_id, px, py, sqrt((px - x0) * (px - x0) + (py - y0) * (py - y0)) AS l1, sqrt((x0 + length_m - px) * (x0 + length_m - px) + (py - y0) * (py - y0)) AS l2 FROM mids)""")
def line_geometry(spark, sf):
    mid = geo.line_midpoint(F.col("coords"))
    return t.network(spark, sf).withColumn("mid", mid).select(
        "segment_id", scaled(geo.line_length(F.col("coords")), 6).alias("length_um"),
        scaled(F.col("mid.x"), 6).alias("mid_x_um"), scaled(F.col("mid.y"), 6).alias("mid_y_um"))


@query("P13", f"SELECT zone_order, {scaled_sql('cx', 6)} AS x_um, {scaled_sql('cy', 6)} AS y_um FROM centres")
def zone_centroids(spark, sf):
    return t.zones(spark, sf).withColumn("c", geo.ring_centroid(F.col("rings")[0])).select(
        "zone_order", scaled(F.col("c.x"), 6).alias("x_um"), scaled(F.col("c.y"), 6).alias("y_um"))


_BOX = "SELECT min(lat::DOUBLE) - 0.15::DOUBLE AS b, max(lat::DOUBLE) + 0.15::DOUBLE AS tp, min(lon::DOUBLE) - 0.15::DOUBLE AS l, max(lon::DOUBLE) + 0.15::DOUBLE AS r FROM geocode_cache WHERE lat < '46.5'"


@query("P14", f"SELECT photo_id, lat, lon FROM read_stamps, ({_BOX}) WHERE lat BETWEEN b AND tp AND lon BETWEEN l AND r")
def viewbox_filter(spark, sf):
    site = t.geocode_cache(spark, sf).filter("lat < '46.5'").select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = t.stamps(spark, sf).withColumn("at", geo_at()).select("photo_id", "at.lat", "at.lon")
    return locate.within_viewbox(rows, locate.viewbox(site))


@query("J5", """SELECT s.photo_id, TRY_CAST(g.lat AS DOUBLE) AS geo_lat, CASE WHEN TRY_CAST(g.lat AS DOUBLE) IS NOT NULL THEN g.lon::DOUBLE END AS geo_lon
FROM stamps s LEFT JOIN geocode_cache g ON trim(s.overlay_address) = g.address""")
def geocoded_addresses(spark, sf):
    return locate.geocode_lookup(t.stamps(spark, sf), t.geocode_cache(spark, sf)).select("photo_id", "geo_lat", "geo_lon")


@query("J6", "SELECT photo_id, lat, lon, coord_source, miss_code FROM resolved")
def coordinate_sources(spark, sf):
    return resolved(spark, sf).select("photo_id", "lat", "lon", "coord_source", "miss_code")


@query("J7", "SELECT p.photo_id, i.zone_order FROM points p JOIN inside i USING (px, py)")
def zone_containment(spark, sf):
    points = t.points(spark, sf)
    return points.join(spatial.containing_zone(points, t.zones(spark, sf)), ["px", "py"]).select("photo_id", "zone_order")


@query("J7, J8", "SELECT p.photo_id, a.fcp_name, a.fcp_assignment FROM points p JOIN assigned a USING (px, py)")
def zone_assignment(spark, sf):
    return t.points(spark, sf).join(assigned(spark, sf), ["px", "py"]).select("photo_id", "fcp_name", "fcp_assignment")


@query("J9", "SELECT segment_id, fcp_name FROM tagged")
def line_zones(spark, sf):
    return tagged_lines(spark, sf).select("segment_id", "fcp_name")


@query("J10", f"""SELECT photo_id, segment_id, {rounded('snap_distance_m', 2)} AS snap_distance_m, {rounded('segment_t', 4)} AS segment_t, fcp_name, fcp_assignment
FROM points JOIN snapped USING (px, py)""")
def snapped_photos(spark, sf):
    snapped = locate.snap_photos(t.points(spark, sf), tagged_lines(spark, sf), t.zones(spark, sf), t.site(spark, sf))
    return snapped.select(
        "photo_id", "segment_id", exact_round(F.col("snap_distance_m"), 2).alias("snap_distance_m"),
        exact_round(F.col("segment_t"), 4).alias("segment_t"), "fcp_name", "fcp_assignment")


@query("J12", f"""SELECT photo_id, coalesce({_haversine_sql('lat', 'lon', 'geo_lat', 'geo_lon')} > 150 AND len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b), false) AS conflict
FROM (SELECT *, {tokens_sql('overlay_address')} AS a, {tokens_sql("coalesce(geo_road, '')")} AS b FROM resolved)
WHERE coord_source = 'overlay_latlon'""")
def address_conflicts(spark, sf):
    c = {n: F.col(n) for n in ("lat", "lon", "overlay_address", "geo_lat", "geo_lon", "geo_road")}
    return resolved(spark, sf).filter("coord_source = 'overlay_latlon'").select(
        "photo_id", locate.address_conflict(c["lat"], c["lon"], c["overlay_address"], c["geo_lat"], c["geo_lon"], c["geo_road"]).alias("conflict"))


@query("J13", """SELECT photo_id, CASE WHEN f = '' THEN 'no_label' WHEN 'F' || f <> fcp_name THEN 'fcp_mismatch'
  WHEN NOT list_contains(string_split_regex(duct_main_short, '[\\^:]+'), 'R' || r) THEN 'r_mismatch' ELSE 'ok' END AS label_match
FROM (SELECT s.photo_id, g.fcp_name, g.duct_main_short, coalesce(regexp_extract(paper_label_code, '(?i)\\bF(\\d{3})\\b.*?\\bR(\\d{3})\\b', 1), '') AS f,
  regexp_extract(paper_label_code, '(?i)\\bF(\\d{3})\\b.*?\\bR(\\d{3})\\b', 2) AS r FROM stamps s JOIN segments g ON g.line_order = s.c)""")
def label_matches(spark, sf):
    lines = t.segments(spark, sf).select(F.col("line_order").alias("c"), "fcp_name", "duct_main_short")
    match = locate.label_match(F.col("paper_label_code"), F.concat("fcp_name", F.lit(" schacht")), F.col("duct_main_short"))
    return t.stamps(spark, sf).join(lines, "c").select("photo_id", match.alias("label_match"))


@query("J6", f"""SELECT photo_id, coord_source, {rounded('lat', 7)} AS lat, {rounded('lon', 7)} AS lon FROM resolved""")
def located_photos(spark, sf):
    """The whole location chain on geographic geometry built around the stamps.

    A zone becomes some seventy cells with their edges, which no estimate knows of, so broadcasts go by measured size.
    """
    with measured_broadcasts(spark), released_shuffles(spark):
        lines, zones, site = geographic_network(spark, sf)
        located = locate.locate_photos(t.stamps(spark, sf), t.geocode_cache(spark, sf), lines, zones, site)
        return cut_lineage(located.select("photo_id", "coord_source", "lat", "lon"))


def geographic_network(spark, sf):
    """The planar network laid out in UTM metres near 46.5 N, 14.5 E."""
    dx, dy = 430000.0, 5130000.0

    def shifted(coords):
        return F.transform(coords, lambda c: F.array(c[0] * 10 + dx, c[1] * 10 + dy))

    moved = tagged_lines(spark, sf).withColumn("coords", shifted(F.col("coords")))
    zones = t.zones(spark, sf).withColumn("rings", F.transform("rings", shifted))
    site = t.site(spark, sf).withColumn("rings", F.transform("rings", shifted))
    return moved, zones, site


@query("P26", """SELECT photo_id, layer FROM (
  SELECT photo_id, CASE WHEN k % 29 = 0 THEN 'upload' ELSE 'base' END AS layer, fcp_assignment, k FROM photos WHERE segment_t IS NOT NULL)
WHERE k % 71 <> 0 AND (layer = 'upload' OR fcp_assignment <> 'off_cluster')""")
def map_points(spark, sf):
    photos = t.photos(spark, sf)
    shown = F.when(F.col("k") % 71 != 0, F.col("segment_t"))
    geomatch = photos.select("photo_id", shown.alias("lat"), shown.alias("lon"), "fcp_assignment")
    return mapsets.map_points(geomatch, t.late(photos)).select("photo_id", "layer")


@query("A20", f"""SELECT n_points, min_x, max_x, min_y, max_y, {scaled_sql('centre_x', 3)} AS centre_x_mm, {scaled_sql('centre_y', 3)} AS centre_y_mm,
  greatest((max_x - min_x) * 0.25::DOUBLE, 0.0005::DOUBLE) AS pad_x, greatest((max_y - min_y) * 0.25::DOUBLE, 0.0005::DOUBLE) AS pad_y FROM (
  SELECT count(*) AS n_points, min(px) AS min_x, max(px) AS max_x, min(py) AS min_y, max(py) AS max_y, avg(px) AS centre_x, avg(py) AS centre_y FROM points)""")
def focus_bounds(spark, sf):
    return spatial.bounding_box(t.points(spark, sf), "px", "py").select(
        "n_points", "min_x", "max_x", "min_y", "max_y", scaled(F.col("centre_x"), 3).alias("centre_x_mm"),
        scaled(F.col("centre_y"), 3).alias("centre_y_mm"), "pad_x", "pad_y")

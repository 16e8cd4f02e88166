"""Evidence-shaped views derived from the driver tables by integer arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions.gate import call_cost, ela_flag

STREETS = ["Fasanstraße", "Pirolweg", "Göltschacher Straße", "Hauptstraße", "Kirchengasse", "Am Bühel"]
STAGES = ["ingest", "forensics", "readqc", "geomatch", "classify"]
LIVE_RULE = 29  # every order whose key it divides arrives late


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _code(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 3, "0"))


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned lines: one horizontal line per part on a 60 m grid."""
    p = F.col("p_partkey")
    duct = F.when(p % 3 == 0, F.concat(F.lit("F:"), _code("R", p % 101), F.lit("^"), _code("R", (p + 7) % 101))).otherwise(_code("R", p % 101))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("SEG_"), p.cast("string")).alias("segment_id"), p.alias("line_order"),
        F.col("p_size").cast("double").alias("length_m"), _code("F", p % 9).alias("fcp_name"),
        duct.alias("duct_main_short"), F.when(p % 5 != 1, p % 5 == 0).alias("is_connected_to_home"),
        ((p % 50) * 60).cast("double").alias("x0"), (F.floor(p / 50) * 60).cast("double").alias("y0"),
    )


def _check(k: Column, shift: int, occludes: bool) -> Column:
    r = (k + shift * 3) % 11
    return F.when(r == 0, "no").when(r == 1, "occluded" if occludes else "no").otherwise("yes")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored photos, one per row; about a third is placed on a planned line, the rest has no segment."""
    return _photos(read(spark, sf_dir, "lineitem"))


def _photos(rows: DataFrame) -> DataFrame:
    k, part, supp, line = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    placed = (part % 10 != 0) & (k % (1 + part % 8) == 0)
    checks = {
        name: _check(k, i, i not in (2, 3)) for i, name in enumerate(rules.PHOTO_CHECKS)
    }
    return rows.select(
        F.sha1(F.concat_ws("|", k.cast("string"), part.cast("string"), supp.cast("string"), line.cast("string"),
                           F.col("l_quantity").cast("bigint").cast("string"))).alias("photo_id"),
        k.alias("k"), part.alias("part"), supp.alias("supp"), line.alias("line"),
        F.when(placed, F.concat(F.lit("SEG_"), part.cast("string"))).alias("segment_id"),
        F.when(placed, (k * 7919 % 1000) / 1000.0).alias("segment_t"),
        (k % 97).alias("cluster_id"), (line == 1).alias("is_representative"),
        F.when(line == 7, "off_topic").when(k % 41 == 0, "portrait").when(k % 43 != 0, "scorable").alias("relevance"),
        F.when(k % 79 != 0, _pick(rules.PHASES, supp % 10)).alias("phase"),
        *[c.alias(n) for n, c in checks.items()],
        F.when(k % 53 == 0, "yes").otherwise("no").alias("personal_data_visible"),
        (k % 61 == 0).alias("latlon_vs_address_flag"),
        F.when(k % 67 == 0, "off_cluster").otherwise("inside_polygon").alias("fcp_assignment"),
        F.when(k % 73 == 0, F.lit(float("nan"))).when(k % 71 != 0, (k * 31 % 800) / 10.0).alias("snap_distance_m"),
        F.when(k % 2 == 0, rules.PRICES[0][0]).otherwise(rules.PRICES[1][0]).alias("model"),
        (((k * 13) % 5000 + 100) * 1000).alias("cost_nano"),
        F.when(k % 5 == 0, "  ").otherwise(F.concat(
            (supp % 40 + 1).cast("string"), F.lit(" "), _pick(STREETS, supp % 6), F.lit(", Musterdorf"))).alias("overlay_address"),
        F.when(k % 3 == 0, F.concat(F.lit(" blurred "), (k % 4).cast("string"))).alias("note"),
        ((k * 37 % 400) / 20.0).alias("ela_raw"),
    )


def forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the photos of one order; the lowest id represents."""
    return clustered_photos(spark, sf_dir).select(
        "photo_id", F.col("k").alias("cluster_id"), "line", F.col("leads").alias("is_representative"), ela_flag(F.col("ela_raw")).alias("ela_flag"))


def clustered_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with ``leads``: the lowest id of the photo's order.

    The raw rows are dealt by order; ids and all that is derived, several times
    as wide, are worked out behind that shuffle, and nothing is joined back.
    """
    dealt = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").repartition("l_orderkey")
    return _photos(dealt).withColumn("leads", F.col("photo_id") == F.min("photo_id").over(Window.partitionBy("k")))


def short_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with photo ids as 20 bytes instead of 40 hex digits, for joins that move them."""
    return rows.withColumn("photo_id", F.unhex("photo_id"))


def spelled_id(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


QUALITY_COLUMNS = [
    "relevance", "phase", *rules.PHOTO_CHECKS, "personal_data_visible", "model", "cost_nano", "overlay_address", "note",
]


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores: representatives and second lines, some orders missing."""
    return clustered_photos(spark, sf_dir).filter("(leads OR line = 2) AND k % 19 <> 0").select("photo_id", *QUALITY_COLUMNS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos at planar positions around their line; some far away."""
    k = F.col("k")
    lines = segments(spark, sf_dir).select("segment_id", "x0", "y0", "length_m")
    far = F.when(k % 97 == 0, 5000.0).otherwise(0.0)
    return photos(spark, sf_dir).join(lines, "segment_id").select(
        "photo_id", "k",
        (F.col("x0") + F.col("segment_t") * F.col("length_m") + ((F.col("supp") * 13) % 200 - 100) + far).alias("px"),
        (F.col("y0") + (k % 161 - 80)).cast("double").alias("py"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notched square per 10 x 10 lines, 30 m apart."""
    p = F.col("p_partkey")
    cells = read(spark, sf_dir, "part").select(
        F.floor((p % 50) / 10).alias("c"), F.floor(p / 500).alias("r")
    ).distinct()
    x, y = (F.col("c") * 600).cast("double"), (F.col("r") * 600).cast("double")
    corners = [(0, 0), (570, 0), (570, 570), (300, 400), (0, 570), (0, 0)]
    ring = F.array(*[F.array(x + float(dx), y + float(dy)) for dx, dy in corners])
    order = F.col("r") * 5 + F.col("c")
    return cells.select(order.alias("zone_order"), _code("F", order % 1000).alias("fcp_name"), F.array(ring).alias("rings"))


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site boundary that leaves out the upper fifth of the grid."""
    top = read(spark, sf_dir, "part").agg((F.max(F.floor(F.col("p_partkey") / 50)) * 48).cast("double").alias("top"))
    corners = [(-100.0, -100.0), (3100.0, -100.0), (3100.0, None), (-100.0, None), (-100.0, -100.0)]
    ring = F.array(*[F.array(F.lit(x), F.col("top") if y is None else F.lit(y)) for x, y in corners])
    return top.select(F.lit(0).cast("bigint").alias("zone_order"), F.array(ring).alias("rings"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with geometry; every second one has a bend."""
    x, y, length = F.col("x0"), F.col("y0"), F.col("length_m")
    bent = F.when(F.col("line_order") % 2 == 0, 6.0).otherwise(0.0)
    coords = F.array(F.array(x, y), F.array(x + length / 2, y + bent), F.array(x + length, y))
    return segments(spark, sf_dir).select(
        "segment_id", "line_order", "duct_main_short", coords.alias("coords"),
        (x + length / 2).alias("mid_x"), (y + bent).alias("mid_y"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of five fingerprints, four bits from one to the next."""
    v = F.col("vec_id")
    stem = F.conv(F.substring(F.md5(F.floor(v / 5).cast("string")), 1, 15), 16, 10).cast("bigint")
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), (v % 5 * 4).cast("int")) - 1
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("P"), F.lpad(v.cast("string"), 12, "0")).alias("photo_id"), stem.bitwiseXOR(low).alias("phash")
    )


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed coordinates, addresses and labels in all the forms that occur."""
    c = F.col("c_custkey")
    minute, tenths = (c % 60).cast("string"), c * 7 % 600
    sec = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    comma = F.replace(sec, F.lit("."), F.lit(","))
    digits = F.lpad((c * 7919 % 1000000).cast("string"), 6, "0")
    form = c % 8

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    overlay = (
        F.when(c % 40 == 15, None)
        .when(form == 0, text("46°", minute, "'", sec, "\"N 14°", minute, "'", sec, "\"E"))
        .when(form == 1, text("46° ", minute, "′ ", comma, "″n, 14º ", minute, "´ ", comma, "″ e"))
        .when(form == 2, text("46.", digits, "N 14.", digits, "E"))
        .when(form == 3, text("Lat 46.", digits, ", Long: 14,", digits))
        .when(form == 4, F.lit("GPS unavailable"))
        .when(form == 5, text("446.", digits, "N 14.", digits, "E"))
        .when(form == 6, text("14.", digits, "° W 46.", digits, "° S"))
        .otherwise(text("46°", minute, "'", sec, "\"N"))
    )
    n = c % 600
    address = F.when(c % 3 == 0, F.lit("")).otherwise(text(" ", (n + 1).cast("string"), " ", _pick(STREETS, n % 6), ", Musterdorf "))
    label = (
        F.when(c % 5 == 1, text(_code("F", c % 9), "-", _code("R", c % 101), "-11-or"))
        .when(c % 5 == 2, text(F.lower(_code("F", c % 9)), "-x-", F.lower(_code("R", (c + c % 4) % 101))))
        .when(c % 5 == 3, text("F170 ", F.col("c_mktsegment")))
        .when(c % 5 == 4, text(_code("F", (c + 1) % 9), "-", _code("R", c % 101)))
    )
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), c.cast("string")).alias("photo_id"), c.alias("c"), overlay.alias("overlay_latlon"),
        address.alias("overlay_address"), label.alias("paper_label_code"),
    )


def geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known addresses: hits, empty answers and one malformed kind."""
    n = F.col("c") % 600
    coords = F.concat(F.lit("46."), F.lpad((n * 17 % 1000).cast("string"), 3, "0"))
    return stamps(spark, sf_dir).filter((n % 2 == 0) & (F.trim("overlay_address") != "")).groupBy(
        F.trim("overlay_address").alias("address")
    ).agg(F.min(n).alias("n")).select(
        "address",
        F.when(F.col("n") % 10 == 0, None).when(F.col("n") % 14 == 0, "not a number")
        .otherwise(F.concat(F.lit("46."), F.lpad((F.col("n") * 17 % 1000).cast("string"), 3, "0"))).alias("lat"),
        F.when(F.col("n") % 10 != 0, F.concat(F.lit("14."), F.lpad((F.col("n") * 29 % 1000).cast("string"), 3, "0"))).alias("lon"),
        F.when(F.col("n") % 10 != 0, _pick(STREETS, (F.col("n") + F.col("n") % 4) % 6)).alias("road"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as photo files, with copies and re-submitted names."""
    d = F.col("doc_id")
    name = F.concat((d % 7).cast("string"), F.lit("_Doc"), F.floor(d / 2).cast("string"),
                    F.when(d % 13 == 0, " - Копия").otherwise(""), F.lit(".jpg"))
    return read(spark, sf_dir, "documents").select(
        F.col("text").alias("content"), name.alias("filename"),
        F.concat(F.lit("lot"), (d % 5).cast("string"), F.lit("/"), name).alias("rel_path"),
        F.octet_length("text").cast("bigint").alias("bytes"), d.alias("mtime"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of model calls with their model's prices."""
    text = F.length("text").cast("bigint")
    calls = read(spark, sf_dir, "conversations").select(
        F.sha1(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("photo_id"),
        F.when(F.col("conv_id") % 2 == 0, rules.PRICES[0][0]).otherwise(rules.PRICES[1][0]).alias("model"),
        text.alias("tok_in"), F.floor(text / 5).alias("tok_cache_w"), F.floor(text / 3).alias("tok_cache_r"),
        (F.col("turn") * 10).alias("tok_out"), "text",
    )
    prices = spark.createDataFrame(rules.PRICES, "model string, p_in double, p_cache_w double, p_cache_r double, p_out double")
    return calls.join(F.broadcast(prices), "model")  # the price list is a fixed table of a few rows


def priced(calls: DataFrame) -> DataFrame:
    kinds = ["in", "cache_w", "cache_r", "out"]
    return calls.withColumns({
        "cost_usd": call_cost({k: F.col(f"tok_{k}") for k in kinds}, {k: F.col(f"p_{k}") for k in kinds}),
        "cost_nano": reduce(lambda a, b: a + b, [F.col(f"tok_{k}") * (F.col(f"p_{k}") * 1000).cast("bigint") for k in kinds]),
    })


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as an audit log."""
    kind = F.create_map(*[F.lit(v) for v in (
        "signup", "stage_start", "purchase", "stage_end", "error", "api_fail", "view", "off_cluster", "click", "drop_no_qc")])
    model = F.when(F.col("user_id") % 2 == 0, rules.PRICES[0][0]).otherwise(rules.PRICES[1][0])
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", _pick(STAGES, F.col("user_id") % 5).alias("stage"),
        F.element_at(kind, F.col("event_type")).alias("event"),
        F.when(F.col("event_id") % 11 != 0, model).alias("model"),
        F.round(F.col("value") * 100).cast("bigint").alias("elapsed"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("photo_id"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels."""
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("photo_id"), F.when(F.col("quality") == 1, "depth").otherwise("duct").alias("truth"),
    )


_SCORED_PHASES = ["depth_measure", "duct_laid", "sand_bedded", "paper_label", "tape_laid"]


def _scores(docs: DataFrame, model: Column, phase: Column, line_no: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("photo_id"), model.alias("model"), line_no.alias("line_no"),
        _pick(_SCORED_PHASES, phase % 5).alias("phase"), ((F.col("n_chars") % 900 + 10) * 1000).alias("cost_nano"),
    )


def production_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the production run; every fifth photo was scored twice."""
    docs, d = read(spark, sf_dir, "documents"), F.col("doc_id")
    model = F.when(d % 2 == 0, rules.PRICES[0][0]).otherwise(rules.PRICES[1][0])
    return _scores(docs, model, d * 7, d).unionByName(_scores(docs.filter(d % 5 == 0), model, d * 7 + 1, d + 1000000000))


def bench_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the controlled run, both models on every third photo."""
    docs, d = read(spark, sf_dir, "documents").filter("doc_id % 3 = 0"), F.col("doc_id")
    return reduce(DataFrame.unionByName, [
        _scores(docs, F.lit(price[0]), d * 3 + i, d) for i, price in enumerate(rules.PRICES)
    ])


def late(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("k") % LIVE_RULE == 0)


def early(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("k") % LIVE_RULE != 0)


#: Where the planar metres of the derived network lie on the globe: millionths of a degree.
LON0, LAT0, LON_PER_M, LAT_PER_M = 14300000, 46500000, 13, 9


def _micro(n: Column) -> Column:
    """Millionths of a degree as decimal text."""
    return F.concat(F.floor(n / 1000000).cast("string"), F.lit("."), F.lpad((n % 1000000).cast("string"), 6, "0"))


def _vertex(x: Column, y: Column, x_extra: Column | int = 0) -> Column:
    """A vertex at planar metres (x, y) as GeoJSON text."""
    return F.concat(F.lit("["), _micro(LON0 + x * LON_PER_M + x_extra), F.lit(","), _micro(LAT0 + y * LAT_PER_M), F.lit("]"))


def _geojson(properties: Column, kind: str, vertices: list[Column]) -> Column:
    shape = F.concat_ws(",", *vertices)
    opened, closed = ("[", "]") if kind == "LineString" else ("[[", "]]")
    return F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(f',"geometry":{{"type":"{kind}","coordinates":{opened}'), shape, F.lit(closed + "}}"))


def _collected(features: DataFrame) -> DataFrame:
    """One collection per (lot, order, feature) lot as a line of text, in order over the files."""
    return (
        features.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("order", "feature"))).alias("fs"))
        .repartitionByRange(4, "lot").sortWithinPartitions("lot")
        .select(F.concat(F.lit('{"features":['), F.array_join(F.transform("fs", lambda f: f["feature"]), ","), F.lit("]}")).alias("value"))
    )


def line_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network as line features in degrees, a hundred to a collection; every second line has a bend."""
    x, y, m = (F.col(c).cast("bigint") for c in ("x0", "y0", "length_m"))
    n = F.col("line_order")
    props = F.struct(F.col("segment_id").alias("externalID"), F.col("duct_main_short").alias("ductMainShort"), F.col("is_connected_to_home").alias("isConnectedToHome"))
    middle = _vertex(x, y + F.when(n % 2 == 0, 6).otherwise(0), F.floor(m * LON_PER_M / 2))
    feature = _geojson(props, "LineString", [_vertex(x, y), middle, _vertex(x + m, y)])
    return _collected(segments(spark, sf_dir).select(F.floor(n / 100).alias("lot"), n.alias("order"), feature.alias("feature")))


def _ring_collections(rows: DataFrame, name: Column) -> DataFrame:
    """Polygon features from planar rings of whole metres."""
    corners = F.transform(F.col("rings")[0], lambda c: _vertex(c[0].cast("bigint"), c[1].cast("bigint")))
    props = F.struct(name.alias("kmlDescriptionSimple"))
    return _collected(rows.select(
        F.floor(F.col("zone_order") / 100).alias("lot"), F.col("zone_order").alias("order"), _geojson(props, "Polygon", [F.array_join(corners, ",")]).alias("feature")))


def zone_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ring_collections(zones(spark, sf_dir), F.concat("fcp_name", F.lit(" ["), F.col("zone_order").cast("string"), F.lit("]")))


def site_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ring_collections(site(spark, sf_dir), F.lit("site"))


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of photographed documents around every third line, with all kinds of stamps; some are missing."""
    d = F.col("d")
    p = (d % 151) * 3 + 1
    x = (p % 50) * 60 + d * 7 % 50
    y = F.floor(p / 50) * 60 + d % 41 - 20 + F.when(d % 97 == 0, 5000).otherwise(0)
    lat, lon = _micro(LAT0 + y * LAT_PER_M), _micro(LON0 + x * LON_PER_M)
    stamp = (
        F.when(d % 5 == 1, F.concat(lat, F.lit("N "), lon, F.lit("E"))).when(d % 5 == 2, F.concat(F.lit("Lat "), lat, F.lit(", Long: "), F.replace(lon, F.lit("."), F.lit(","))))
        .when(d % 5 == 3, F.lit("GPS unavailable")).when(d % 5 == 4, F.concat(lon, F.lit("° E "), lat, F.lit("° N")))
    )
    n = d % 600
    address = F.when(d % 3 == 0, "").otherwise(F.concat(F.lit(" "), (n + 1).cast("string"), F.lit(" "), _pick(STREETS, n % 6), F.lit(", Musterdorf ")))
    zone = F.floor(p / 500) * 5 + F.floor((p % 50) / 10)
    label = F.when(d % 4 != 0, F.concat(_code("F", zone + F.when(d % 4 == 2, 1).otherwise(0)), F.lit("-"), _code("R", (p + d % 2) % 101)))
    checks = {name: _check(d, i, i not in (2, 3)) for i, name in enumerate(rules.PHOTO_CHECKS)}
    return (
        read(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("photo_id")).agg(F.min("doc_id").alias("d")).filter(d % 19 != 0)
        .select(
            "photo_id", stamp.alias("overlay_latlon"), address.alias("overlay_address"), label.alias("paper_label_code"),
            F.when(d % 11 == 3, "off_topic").when(d % 43 != 5, "scorable").alias("relevance"),
            _pick(["duct_laid", "backfilled", "restored", "depth_measure", "paper_label"], F.floor(d / 5) % 5).alias("phase"),
            *[c.alias(k) for k, c in checks.items()], F.when(d % 53 == 0, "yes").otherwise("no").alias("personal_data_visible"),
            F.when(d % 2 == 0, " blurred ").alias("note"))
    )


def field_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints as 16 hex digits in chains of five; every 59th photo could not be hashed."""
    d = F.col("d")
    digits = F.concat(F.substring(F.md5(F.floor(d / 5).cast("string")), 1, 14), _pick(["00", "01", "03", "07", "ff"], d % 5))
    return read(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("photo_id")).agg(F.min("doc_id").alias("d")).select(
        "photo_id", F.when(d % 59 == 0, "").otherwise(digits).alias("phash"), (d * 37 % 400 / 20.0).alias("ela_raw"))

"""The derived views again, as DuckDB SQL over the driver tables."""

from __future__ import annotations

import re

from fieldproof import rules
from fieldproof.functions import geo
from fieldproof.plans.tables import LIVE_RULE, STAGES, STREETS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def rounded(x: str, digits: int) -> str:
    """Round-half-even on the exact value of column ``x``."""
    s = f"{10 ** digits}::DOUBLE"
    p, high = f"({x}*{s})", f"({x}*134217729::DOUBLE - ({x}*134217729::DOUBLE - {x}))"
    err = f"(({high}*{s} - {p}) + ({x} - {high})*{s})"
    d = f"((({p} - floor({p})) - 0.5::DOUBLE) + {err})"
    up = f"({d} > 0 OR ({d} = 0 AND abs(floor({p}) % 2) = 1))"
    return f"((floor({p}) + CASE WHEN {up} THEN 1::DOUBLE ELSE 0::DOUBLE END) / {s})"


def planar_sql(source: str, columns: str) -> str:
    """``columns`` and (east, north) of (lon, lat) in ``source``, step by step."""
    terms = enumerate(geo._ALPHA, 1)
    east, north = "eta", "xi"
    for j, a in terms:
        east += f" + ({a!r})::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        north += f" + ({a!r})::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = f"({geo._SCALE * geo._MERIDIAN!r})::DOUBLE"
    return f"""SELECT {columns}, 500000::DOUBLE + {k} * ({east}) AS east, {k} * ({north}) AS north FROM (
  SELECT *, atan2(conformal, cos(delta)) AS xi, atanh(sin(delta) / sqrt(1 + conformal * conformal)) AS eta FROM (
    SELECT *, sinh(atanh(sine) - ({geo._ECC!r})::DOUBLE * atanh(({geo._ECC!r})::DOUBLE * sine)) AS conformal, radians(lon - 15) AS delta FROM (
      SELECT *, sin(radians(lat)) AS sine FROM {source})))"""


def whole(x: str) -> str:
    return f"CAST(CAST(round_even(({x})::DOUBLE, 0) AS BIGINT) AS VARCHAR)"


def _pick(values: list[str], index: str) -> str:
    return f"{listed(values)}[({index}) + 1]"


def _code(prefix: str, number: str) -> str:
    return f"'{prefix}' || lpad(({number})::VARCHAR, 3, '0')"


def _check(shift: int, occludes: bool) -> str:
    r = f"((l_orderkey + {shift * 3}) % 11)"
    return f"CASE {r} WHEN 0 THEN 'no' WHEN 1 THEN '{'occluded' if occludes else 'no'}' ELSE 'yes' END"


def tokens_sql(address: str) -> str:
    plain = f"lower(regexp_replace(strip_accents({address}), '[^\\x00-\\x7F]', '', 'g'))"
    words = f"list_filter(string_split_regex({plain}, '[^a-z]+'), lambda w: length(w) > 2)"
    return f"list_sort(list_distinct(list_concat({words}, list_transform(list_filter({words}, lambda w: contains(w, 'strasse')), lambda w: replace(w, 'strasse', '')))))"


SONNET, HAIKU = rules.PRICES[0][0], rules.PRICES[1][0]
_ROUTE = f"CASE WHEN {{0}} % 2 = 0 THEN '{SONNET}' ELSE '{HAIKU}' END"
_SCORED = ["depth_measure", "duct_laid", "sand_bedded", "paper_label", "tape_laid"]

VIEWS: dict[str, str] = {}

VIEWS["segments"] = f"""
SELECT 'SEG_' || p_partkey AS segment_id, p_partkey AS line_order, p_size::DOUBLE AS length_m,
  {_code('F', 'p_partkey % 9')} AS fcp_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'F:' || {_code('R', 'p_partkey % 101')} || '^' || {_code('R', '(p_partkey + 7) % 101')}
       ELSE {_code('R', 'p_partkey % 101')} END AS duct_main_short,
  CASE WHEN p_partkey % 5 <> 1 THEN p_partkey % 5 = 0 END AS is_connected_to_home,
  ((p_partkey % 50) * 60)::DOUBLE AS x0, ((p_partkey // 50) * 60)::DOUBLE AS y0
FROM part"""

_PLACED = "l_partkey % 10 <> 0 AND l_orderkey % (1 + l_partkey % 8) = 0"

VIEWS["photos"] = f"""
SELECT sha1(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT)) AS photo_id,
  l_orderkey AS k, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line,
  CASE WHEN {_PLACED} THEN 'SEG_' || l_partkey END AS segment_id,
  CASE WHEN {_PLACED} THEN (l_orderkey * 7919 % 1000) / 1000::DOUBLE END AS segment_t,
  l_orderkey % 97 AS cluster_id, l_linenumber = 1 AS is_representative,
  CASE WHEN l_linenumber = 7 THEN 'off_topic' WHEN l_orderkey % 41 = 0 THEN 'portrait'
       WHEN l_orderkey % 43 <> 0 THEN 'scorable' END AS relevance,
  CASE WHEN l_orderkey % 79 <> 0 THEN {_pick(rules.PHASES, 'l_suppkey % 10')} END AS phase,
  {', '.join(f'{_check(i, i not in (2, 3))} AS {n}' for i, n in enumerate(rules.PHOTO_CHECKS))},
  CASE WHEN l_orderkey % 53 = 0 THEN 'yes' ELSE 'no' END AS personal_data_visible,
  l_orderkey % 61 = 0 AS latlon_vs_address_flag,
  CASE WHEN l_orderkey % 67 = 0 THEN 'off_cluster' ELSE 'inside_polygon' END AS fcp_assignment,
  CASE WHEN l_orderkey % 73 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 71 <> 0 THEN (l_orderkey * 31 % 800) / 10::DOUBLE END AS snap_distance_m,
  {_ROUTE.format('l_orderkey')} AS model, ((l_orderkey * 13) % 5000 + 100) * 1000 AS cost_nano,
  CASE WHEN l_orderkey % 5 = 0 THEN '  ' ELSE (l_suppkey % 40 + 1) || ' ' || {_pick(STREETS, 'l_suppkey % 6')} || ', Musterdorf' END AS overlay_address,
  CASE WHEN l_orderkey % 3 = 0 THEN ' blurred ' || (l_orderkey % 4) END AS note,
  (l_orderkey * 37 % 400) / 20::DOUBLE AS ela_raw
FROM lineitem"""

_CODES = """list_filter([
  CASE WHEN relevance IS DISTINCT FROM 'scorable' THEN 'relevance=' || coalesce(relevance, 'None') END,
  CASE WHEN personal_data_visible = 'yes' THEN 'personal_data_visible' END,
  CASE WHEN latlon_vs_address_flag THEN 'latlon_vs_address_disagree' END,
  CASE WHEN fcp_assignment = 'off_cluster' THEN 'off_cluster' END,
  CASE WHEN NOT isnan(snap_distance_m) AND snap_distance_m > 75 THEN 'snap_distance=' || {snap} || 'm' END,
  CASE WHEN phase IS NULL OR phase IN ('paper_label', 'staging', 'other') THEN 'phase=' || coalesce(phase, 'None') END,
  CASE WHEN phase = 'depth_measure' AND depth_reference_visible IS DISTINCT FROM 'yes' THEN 'depth_reference_visible=' || coalesce(depth_reference_visible, 'None') END,
  CASE WHEN phase IN ('excavation', 'depth_measure') AND side_view_present IS DISTINCT FROM 'yes' THEN 'side_view_present=' || coalesce(side_view_present, 'None') END,
  CASE WHEN phase = 'tape_laid' AND warning_tape_visible IS DISTINCT FROM 'yes' THEN 'warning_tape_visible=' || coalesce(warning_tape_visible, 'None') END,
  CASE WHEN phase = 'sand_bedded' AND sand_bedding_visible IS DISTINCT FROM 'yes' THEN 'sand_bedding_visible=' || coalesce(sand_bedding_visible, 'None') END,
  CASE WHEN phase IN ('duct_laid', 'sand_bedded') AND duct_visible IS DISTINCT FROM 'yes' THEN 'duct_visible=' || coalesce(duct_visible, 'None') END
], lambda x: x IS NOT NULL)""".format(snap=whole("CASE WHEN isnan(snap_distance_m) THEN 0 ELSE snap_distance_m END"))


def _judged(source: str) -> str:
    return f"SELECT *, len(codes) = 0 AS compliant FROM (SELECT *, {_CODES} AS codes FROM {source})"


def _entries(source: str) -> str:
    return f"""SELECT * FROM {source} WHERE segment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id, cluster_id
  ORDER BY CASE WHEN compliant THEN 0 ELSE 1 END, CASE WHEN is_representative THEN 0 ELSE 1 END, photo_id) = 1"""


VIEWS["judged"] = _judged("photos")
VIEWS["entries"] = _entries("judged")


def _gap_views(suffix: str, entries: str) -> dict[str, str]:
    """Gaps, rollup, reasons and verdicts over one set of entries."""
    return {
        f"gaps{suffix}": f"""
SELECT segment_id, length_m, row_number() OVER w - 1 AS gap_no,
  CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(pos) OVER w END AS from_m, pos AS to_m,
  pos - CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(pos) OVER w END AS gap_m
FROM (SELECT segment_id, length_m, t, pos, 0 AS tail FROM (
        SELECT DISTINCT segment_id, length_m, segment_t AS t, segment_t * length_m AS pos
        FROM {entries} JOIN segments USING (segment_id) WHERE compliant)
      UNION ALL
      SELECT DISTINCT segment_id, length_m, 2::DOUBLE, length_m, 1 FROM {entries} JOIN segments USING (segment_id) WHERE compliant)
WINDOW w AS (PARTITION BY segment_id ORDER BY tail, t)""",
        f"worst{suffix}": f"""
SELECT segment_id, gap_no, from_m, to_m, gap_m, n_positions FROM (
  SELECT *, count(*) OVER (PARTITION BY segment_id) - 1 AS n_positions FROM gaps{suffix})
QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY gap_m DESC, gap_no) = 1""",
        f"reason_ranks{suffix}": f"""
SELECT segment_id, reason, n, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, reason) AS rank
FROM (SELECT segment_id, reason, count(*) AS n FROM (
  SELECT segment_id, unnest(codes) AS reason FROM {entries} WHERE NOT compliant) GROUP BY ALL)""",
        f"state{suffix}": f"""
SELECT s.segment_id, s.fcp_name, s.length_m, coalesce(e.n, 0) AS photo_count, coalesce(e.ok, 0) AS compliant_photo_count,
  coalesce(e.personal, 0) AS personal_count, w.gap_no, w.from_m, w.to_m, w.gap_m, w.n_positions
FROM segments s LEFT JOIN (
  SELECT segment_id, count(*) AS n, count(*) FILTER (compliant) AS ok,
    count(*) FILTER (list_contains(codes, 'personal_data_visible')) AS personal FROM {entries} GROUP BY 1) e USING (segment_id)
LEFT JOIN worst{suffix} w USING (segment_id)""",
        f"ruled{suffix}": f"""
SELECT *, CASE WHEN compliant_photo_count = 0 THEN 'RED' WHEN length_m <= 5 THEN 'GREEN'
    WHEN compliant_photo_count / length_m < 0.1::DOUBLE THEN 'RED' WHEN gap_m <= 5 THEN 'GREEN' ELSE 'YELLOW' END AS verdict,
  CASE WHEN compliant_photo_count = 0 THEN length_m WHEN length_m <= 5 THEN 0 ELSE gap_m END AS raw_gap_m,
  CASE WHEN compliant_photo_count = 0 THEN 'no compliant photos snapped' WHEN length_m <= 5 THEN NULL
    WHEN compliant_photo_count / length_m < 0.1::DOUBLE THEN 'density ' || compliant_photo_count || '/' || {whole('length_m')} || 'm below 1/10m'
    WHEN gap_m <= 5 THEN NULL
    WHEN gap_no = 0 THEN 'first compliant photo at meter ' || {whole('to_m')} || ' (>5m from start)'
    WHEN gap_no = n_positions THEN 'last compliant photo at meter ' || {whole('from_m')} || ' (>5m from end of ' || {whole('length_m')} || 'm)'
    ELSE 'max gap ' || {whole('gap_m')} || 'm > 5m between meter ' || {whole('from_m')} || ' and meter ' || {whole('to_m')} END AS gap_reason,
  compliant_photo_count / (length_m / 5::DOUBLE) AS raw_density
FROM state{suffix}""",
        f"verdicts{suffix}": f"""
SELECT r.segment_id, fcp_name, {rounded('length_m', 2)} AS length_m, photo_count, compliant_photo_count,
  {rounded('raw_gap_m', 2)} AS max_gap_m, {rounded('raw_density', 3)} AS density_photos_per_5m, verdict,
  concat_ws('; ', gap_reason, top, CASE WHEN personal_count > 0 THEN personal_count || ' personal-data photo(s)' END) AS reasons
FROM ruled{suffix} r LEFT JOIN (
  SELECT segment_id, string_agg(n || 'x ' || reason, '; ' ORDER BY rank) AS top FROM reason_ranks{suffix} WHERE rank <= 3 GROUP BY 1
) t ON r.segment_id = t.segment_id""",
    }


VIEWS.update(_gap_views("", "entries"))

# State before the late arrivals, and after each arrival became its own cluster.
VIEWS["early_entries"] = _entries(f"(SELECT * FROM judged WHERE k % {LIVE_RULE} <> 0)")
VIEWS.update(_gap_views("_early", "early_entries"))
VIEWS["merged_entries"] = _entries(
    f"(SELECT * REPLACE (CASE WHEN k % {LIVE_RULE} = 0 THEN photo_id ELSE cluster_id::VARCHAR END AS cluster_id, "
    f"CASE WHEN k % {LIVE_RULE} = 0 THEN true ELSE is_representative END AS is_representative) FROM judged)"
)
VIEWS.update(_gap_views("_merged", "merged_entries"))

VIEWS["forensics"] = """
SELECT photo_id, k AS cluster_id, line, photo_id = min(photo_id) OVER (PARTITION BY k) AS is_representative, ela_raw > 15 AS ela_flag
FROM photos"""
QUALITY_SQL = ["relevance", "phase", *rules.PHOTO_CHECKS, "personal_data_visible", "model", "cost_nano", "overlay_address", "note"]
_QUALITY = ", ".join(QUALITY_SQL)
VIEWS["quality"] = f"""
SELECT photo_id, {_QUALITY} FROM photos WHERE photo_id IN (
  SELECT photo_id FROM forensics WHERE (is_representative OR line = 2) AND cluster_id % 19 <> 0)"""

VIEWS["points"] = """
SELECT photo_id, k, x0 + segment_t * length_m + ((supp * 13) % 200 - 100) + CASE WHEN k % 97 = 0 THEN 5000::DOUBLE ELSE 0::DOUBLE END AS px,
  (y0 + (k % 161 - 80))::DOUBLE AS py
FROM photos JOIN segments USING (segment_id)"""
VIEWS["zones"] = """
SELECT DISTINCT r * 5 + c AS zone_order, 'F' || lpad(((r * 5 + c) % 1000)::VARCHAR, 3, '0') AS fcp_name,
  (c * 600)::DOUBLE AS x, (r * 600)::DOUBLE AS y
FROM (SELECT (p_partkey % 50) // 10 AS c, p_partkey // 500 AS r FROM part)"""
VIEWS["zone_edges"] = """
SELECT zone_order, x + a[1] AS x1, y + a[2] AS y1, x + a[3] AS x2, y + a[4] AS y2
FROM zones, (SELECT unnest([[0,0,570,0],[570,0,570,570],[570,570,300,400],[300,400,0,570],[0,570,0,0]]::DOUBLE[][]) AS a)"""
VIEWS["site_top"] = "SELECT (max(p_partkey // 50) * 48)::DOUBLE AS top FROM part"
VIEWS["spots"] = "SELECT DISTINCT px, py FROM points"


def containing(points: str) -> str:
    """First zone whose outline the point's ray crosses an odd number of times."""
    return f"""SELECT px, py, min(zone_order) AS zone_order FROM (
  SELECT px, py, zone_order FROM {points}, zone_edges
  GROUP BY ALL HAVING count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1) % 2 = 1) GROUP BY 1, 2"""


_DIST = """sqrt((px - (x1 + u * (x2 - x1))) * (px - (x1 + u * (x2 - x1))) + (py - (y1 + u * (y2 - y1))) * (py - (y1 + u * (y2 - y1))))"""
_SHARE = """coalesce(least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 1), 0)"""

VIEWS["inside"] = containing("spots")
VIEWS["outlines"] = f"""
SELECT px, py, zone_order FROM (SELECT *, {_DIST} AS d FROM (
  SELECT *, {_SHARE} AS u FROM (SELECT * FROM spots ANTI JOIN inside USING (px, py)), zone_edges))
QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY d, zone_order) = 1"""
VIEWS["assigned"] = """
SELECT s.px, s.py, z.fcp_name, CASE WHEN NOT (s.px >= -100 AND s.px < 3100 AND s.py >= -100 AND s.py < top) THEN 'off_cluster'
  WHEN i.zone_order IS NOT NULL THEN 'inside_polygon' ELSE 'nearest_fallback' END AS fcp_assignment
FROM spots s CROSS JOIN site_top LEFT JOIN inside i USING (px, py) LEFT JOIN outlines o USING (px, py)
JOIN zones z ON z.zone_order = coalesce(i.zone_order, o.zone_order)"""
VIEWS["mids"] = """
SELECT segment_id, line_order, duct_main_short, x0 + length_m / 2 AS px,
  y0 + CASE WHEN line_order % 2 = 0 THEN 6::DOUBLE ELSE 0::DOUBLE END AS py, x0, y0, length_m FROM segments"""
VIEWS["mid_inside"] = containing("(SELECT DISTINCT px, py FROM mids)")
# Area centroid of the notched square, relative to its corner.
VIEWS["centres"] = """
SELECT zone_order, x + sum((ax + bx) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)) AS cx,
  y + sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)) AS cy
FROM (SELECT zone_order, z.x, z.y, x1 - z.x AS ax, y1 - z.y AS ay, x2 - z.x AS bx, y2 - z.y AS by_ FROM zone_edges JOIN zones z USING (zone_order))
GROUP BY zone_order, x, y"""
VIEWS["tagged"] = """
SELECT m.*, z.fcp_name FROM mids m LEFT JOIN mid_inside i USING (px, py) LEFT JOIN (
  SELECT px, py, zone_order FROM (SELECT DISTINCT px, py FROM mids) AS p, centres
  QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)), zone_order) = 1
) n USING (px, py) JOIN zones z ON z.zone_order = coalesce(i.zone_order, n.zone_order)"""
VIEWS["line_edges"] = """
SELECT segment_id, line_order, fcp_name, e AS edge_no,
  CASE WHEN e = 0 THEN x0 ELSE px END AS x1, CASE WHEN e = 0 THEN y0 ELSE py END AS y1,
  CASE WHEN e = 0 THEN px ELSE x0 + length_m END AS x2, CASE WHEN e = 0 THEN py ELSE y0 END AS y2
FROM tagged, (SELECT unnest([0, 1]) AS e)"""
VIEWS["edge_offsets"] = """
SELECT *, coalesce(sum(len) OVER (PARTITION BY segment_id ORDER BY edge_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS off,
  first_value(len) OVER (PARTITION BY segment_id ORDER BY edge_no) + last_value(len) OVER (PARTITION BY segment_id ORDER BY edge_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM line_edges)"""
VIEWS["snapped"] = f"""
SELECT px, py, fcp_name, fcp_assignment, segment_id, d AS snap_distance_m,
  coalesce(least(greatest((off + u * len) / nullif(total, 0), 0), 1), 0) AS segment_t
FROM (SELECT *, {_DIST} AS d FROM (SELECT *, {_SHARE} AS u FROM assigned JOIN edge_offsets USING (fcp_name)))
QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY d, line_order, edge_no) = 1"""

VIEWS["fingerprints"] = """
SELECT 'P' || lpad(vec_id::VARCHAR, 12, '0') AS photo_id,
  xor(('0x' || substr(md5((vec_id // 5)::VARCHAR), 1, 15))::BIGINT, (1::BIGINT << (vec_id % 5 * 4)::INT) - 1) AS phash
FROM embeddings"""
VIEWS["fp_pairs"] = """
SELECT a.phash AS a_fp, b.phash AS b_fp, bit_count(xor(a.phash, b.phash))::INT AS distance
FROM (SELECT DISTINCT phash FROM fingerprints) a JOIN (SELECT DISTINCT phash FROM fingerprints) b
  ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 6"""
VIEWS["reach"] = """
SELECT phash AS node, phash AS other FROM fingerprints
UNION SELECT r.node, e.other FROM reach r JOIN (
  SELECT a_fp AS node, b_fp AS other FROM fp_pairs UNION ALL SELECT b_fp, a_fp FROM fp_pairs) e ON e.node = r.other"""
VIEWS["clusters"] = """
SELECT photo_id, phash, min(photo_id) OVER (PARTITION BY root) AS cluster_id
FROM fingerprints JOIN (SELECT node, min(other) AS root FROM reach GROUP BY 1) ON node = phash"""

_STREET = _pick(STREETS, "n % 6")
VIEWS["stamps"] = f"""
SELECT 'C' || c AS photo_id, c,
  CASE WHEN c % 40 = 15 THEN NULL ELSE CASE c % 8
    WHEN 0 THEN '46°' || mi || '''' || sec || '"N 14°' || mi || '''' || sec || '"E'
    WHEN 1 THEN '46° ' || mi || '′ ' || comma || '″n, 14º ' || mi || '´ ' || comma || '″ e'
    WHEN 2 THEN '46.' || dig || 'N 14.' || dig || 'E' WHEN 3 THEN 'Lat 46.' || dig || ', Long: 14,' || dig
    WHEN 4 THEN 'GPS unavailable' WHEN 5 THEN '446.' || dig || 'N 14.' || dig || 'E'
    WHEN 6 THEN '14.' || dig || '° W 46.' || dig || '° S' ELSE '46°' || mi || '''' || sec || '"N' END END AS overlay_latlon,
  CASE WHEN c % 3 = 0 THEN '' ELSE ' ' || (n + 1) || ' ' || {_STREET} || ', Musterdorf ' END AS overlay_address,
  CASE c % 5 WHEN 1 THEN {_code('F', 'c % 9')} || '-' || {_code('R', 'c % 101')} || '-11-or'
    WHEN 2 THEN lower({_code('F', 'c % 9')}) || '-x-' || lower({_code('R', '(c + c % 4) % 101')})
    WHEN 3 THEN 'F170 ' || c_mktsegment WHEN 4 THEN {_code('F', '(c + 1) % 9')} || '-' || {_code('R', 'c % 101')} END AS paper_label_code
FROM (SELECT c_custkey AS c, c_mktsegment, (c_custkey % 60)::VARCHAR AS mi, c_custkey % 600 AS n,
  ((c_custkey * 7 % 600) // 10) || '.' || (c_custkey * 7 % 600 % 10) AS sec, ((c_custkey * 7 % 600) // 10) || ',' || (c_custkey * 7 % 600 % 10) AS comma,
  lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') AS dig FROM customer)"""
VIEWS["geocode_cache"] = f"""
SELECT address, CASE WHEN n % 10 = 0 THEN NULL WHEN n % 14 = 0 THEN 'not a number' ELSE '46.' || lpad((n * 17 % 1000)::VARCHAR, 3, '0') END AS lat,
  CASE WHEN n % 10 <> 0 THEN '14.' || lpad((n * 29 % 1000)::VARCHAR, 3, '0') END AS lon,
  CASE WHEN n % 10 <> 0 THEN {_pick(STREETS, '(n + n % 4) % 6')} END AS road
FROM (SELECT trim(overlay_address) AS address, min(c % 600) AS n FROM stamps WHERE c % 600 % 2 = 0 AND trim(overlay_address) <> '' GROUP BY 1)"""

# The stamp is read as (value, hemisphere) pairs, first two of each notation.
_DMS, _HEMI, _LABEL = (quote(p) for p in (rules.DMS_PATTERN, rules.DECIMAL_HEMISPHERE_PATTERN, rules.DECIMAL_LABEL_PATTERN))


def _num(x: str) -> str:
    return f"try_cast(replace({x}, ',', '.') AS DOUBLE)"


def _signed(value: str, hemi: str) -> str:
    return f"CASE WHEN upper({hemi}) IN ('S', 'W') THEN -({value}) ELSE {value} END"


def _dms(i: int) -> str:
    return f"{_num(f'dd[{i}]')} + {_num(f'dm[{i}]')} / 60 + {_num(f'ds[{i}]')} / 3600"


VIEWS["read_stamps"] = f"""
SELECT photo_id, c, overlay_address, paper_label_code,
  CASE WHEN ok1 THEN CASE WHEN n1 THEN a1 ELSE b1 END WHEN ok2 THEN CASE WHEN n2 THEN a2 ELSE b2 END WHEN ok3 THEN CASE WHEN n3 THEN a3 ELSE b3 END END AS lat,
  CASE WHEN ok1 THEN CASE WHEN n1 THEN b1 ELSE a1 END WHEN ok2 THEN CASE WHEN n2 THEN b2 ELSE a2 END WHEN ok3 THEN CASE WHEN n3 THEN b3 ELSE a3 END END AS lon
FROM (SELECT *, {', '.join(
    f'''coalesce(n{i} <> m{i} AND CASE WHEN n{i} THEN a{i} ELSE b{i} END BETWEEN -90 AND 90
      AND CASE WHEN n{i} THEN b{i} ELSE a{i} END BETWEEN -180 AND 180, false) AS ok{i}''' for i in (1, 2, 3))}
  FROM (SELECT *, upper(dh[1]) IN ('N', 'S') AS n1, upper(dh[2]) IN ('N', 'S') AS m1, {_signed(_dms(1), 'dh[1]')} AS a1, {_signed(_dms(2), 'dh[2]')} AS b1,
    upper(hh[1]) IN ('N', 'S') AS n2, upper(hh[2]) IN ('N', 'S') AS m2, {_signed(_num('hv[1]'), 'hh[1]')} AS a2, {_signed(_num('hv[2]'), 'hh[2]')} AS b2,
    lower(ll[1]) LIKE 'lat%' AS n3, lower(ll[2]) LIKE 'lat%' AS m3, {_num('lv[1]')} AS a3, {_num('lv[2]')} AS b3
    FROM (SELECT photo_id, c, overlay_address, paper_label_code, {', '.join(
        f'regexp_extract_all(txt, {p}, {g}) AS {n}' for n, p, g in (
            ('dd', _DMS, 1), ('dm', _DMS, 2), ('ds', _DMS, 3), ('dh', _DMS, 4), ('hv', _HEMI, 1), ('hh', _HEMI, 2), ('ll', _LABEL, 1), ('lv', _LABEL, 2)))}
      FROM (SELECT *, replace(replace(replace(overlay_latlon, '´', ''''), '′', ''''), '″', '"') AS txt FROM stamps))))"""
VIEWS["resolved"] = """
SELECT r.photo_id, r.c, r.overlay_address, r.paper_label_code, coalesce(r.lat, g.lat) AS lat, coalesce(r.lon, g.lon) AS lon,
  g.lat AS geo_lat, g.lon AS geo_lon, g.road AS geo_road,
  CASE WHEN r.lat IS NOT NULL THEN 'overlay_latlon' WHEN g.lat IS NOT NULL THEN 'geocoded_address' ELSE 'none' END AS coord_source,
  CASE WHEN r.lat IS NOT NULL OR g.lat IS NOT NULL THEN NULL WHEN trim(r.overlay_address) <> '' THEN 'uncached_address' ELSE 'no_address' END AS miss_code
FROM read_stamps r LEFT JOIN (SELECT address, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon, coalesce(road, '') AS road FROM geocode_cache
  WHERE try_cast(lat AS DOUBLE) IS NOT NULL AND try_cast(lon AS DOUBLE) IS NOT NULL) g ON trim(r.overlay_address) = g.address"""

VIEWS["files"] = """
SELECT text AS content, name AS filename, 'lot' || (doc_id % 5) || '/' || name AS rel_path, strlen(text)::BIGINT AS bytes, doc_id AS mtime,
  sha1(text) AS photo_id
FROM (SELECT *, (doc_id % 7) || '_Doc' || (doc_id // 2) || CASE WHEN doc_id % 13 = 0 THEN ' - Копия' ELSE '' END || '.jpg' AS name FROM documents)"""
VIEWS["manifest"] = """
SELECT photo_id, filename, rel_path, bytes, mtime FROM files
QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY filename, rel_path, bytes, mtime) = 1"""
VIEWS["usage"] = f"""
SELECT *, tok_in * p_in / 1000000 + tok_cache_w * p_cache_w / 1000000 + tok_cache_r * p_cache_r / 1000000 + tok_out * p_out / 1000000 AS cost_usd,
  tok_in * (p_in * 1000)::BIGINT + tok_cache_w * (p_cache_w * 1000)::BIGINT + tok_cache_r * (p_cache_r * 1000)::BIGINT + tok_out * (p_out * 1000)::BIGINT AS cost_nano
FROM (SELECT sha1(concat_ws('|', conv_id, turn)) AS photo_id, {_ROUTE.format('conv_id')} AS model, length(text)::BIGINT AS tok_in,
  length(text)::BIGINT // 5 AS tok_cache_w, length(text)::BIGINT // 3 AS tok_cache_r, turn * 10 AS tok_out, text FROM conversations)
JOIN (VALUES {', '.join(str(p[:1])[:-2] + ', ' + ', '.join(f'{v}::DOUBLE' for v in p[1:]) + ')' for p in rules.PRICES)}) p(model, p_in, p_cache_w, p_cache_r, p_out) USING (model)"""
VIEWS["audit_events"] = f"""
SELECT event_id, ts, {_pick(STAGES, '(user_id % 5)')} AS stage,
  CASE event_type WHEN 'signup' THEN 'stage_start' WHEN 'purchase' THEN 'stage_end' WHEN 'error' THEN 'api_fail' WHEN 'view' THEN 'off_cluster' WHEN 'click' THEN 'drop_no_qc' END AS event,
  CASE WHEN event_id % 11 <> 0 THEN {_ROUTE.format('user_id')} END AS model, round(value * 100)::BIGINT AS elapsed, 'E' || event_id AS photo_id
FROM events"""
VIEWS["stage_runs"] = """
SELECT stage, prev_model AS model, prev_id AS start_id, event_id AS end_id, elapsed FROM (
  SELECT *, lag(event) OVER w AS prev_event, lag(model) OVER w AS prev_model, lag(event_id) OVER w AS prev_id
  FROM audit_events WHERE event IN ('stage_start', 'stage_end') WINDOW w AS (PARTITION BY stage ORDER BY ts, event_id))
WHERE event = 'stage_end' AND prev_event = 'stage_start' AND prev_model IS NOT NULL"""
VIEWS["truth"] = "SELECT doc_id::VARCHAR AS photo_id, CASE WHEN quality = 1 THEN 'depth' ELSE 'duct' END AS truth FROM labels"


def _score_rows(model: str, phase: str, line: str, where: str, source: int) -> str:
    return f"""SELECT doc_id::VARCHAR AS photo_id, {model} AS model, {line} AS line_no, {_pick(_SCORED, f'({phase}) % 5')} AS phase,
  (n_chars % 900 + 10) * 1000 AS cost_nano, {source} AS source FROM documents WHERE {where}"""


_BY_DOC = _ROUTE.format("doc_id")
VIEWS["production_scores"] = " UNION ALL ".join([
    _score_rows(_BY_DOC, "doc_id * 7", "doc_id", "true", 0),
    _score_rows(_BY_DOC, "doc_id * 7 + 1", "doc_id + 1000000000", "doc_id % 5 = 0", 0)])
VIEWS["bench_scores"] = " UNION ALL ".join([
    _score_rows(f"'{SONNET}'", "doc_id * 3", "doc_id", "doc_id % 3 = 0", 1),
    _score_rows(f"'{HAIKU}'", "doc_id * 3 + 1", "doc_id", "doc_id % 3 = 0", 1)])
VIEWS["scores"] = """
SELECT photo_id, model, source, line_no, phase, cost_nano FROM (SELECT * FROM production_scores UNION ALL SELECT * FROM bench_scores)
QUALIFY row_number() OVER (PARTITION BY photo_id, model ORDER BY source DESC, line_no DESC) = 1"""
VIEWS["accuracy"] = """
SELECT model, n_test, depth_total, depth_correct, duct_total, duct_correct, duct_lenient,
  coalesce(depth_correct * 100::DOUBLE / nullif(depth_total, 0), 0) AS depth_pct, coalesce(duct_correct * 100::DOUBLE / nullif(duct_total, 0), 0) AS duct_pct,
  coalesce(duct_lenient * 100::DOUBLE / nullif(duct_total, 0), 0) AS duct_lenient_pct,
  (depth_correct + duct_correct) * 100::DOUBLE / nullif(n_test, 0) AS accuracy_pct, (depth_correct + duct_lenient) * 100::DOUBLE / nullif(n_test, 0) AS lenient_pct
FROM (SELECT model, count(*) AS n_test, count(*) FILTER (truth = 'depth') AS depth_total,
  count(*) FILTER (truth = 'depth' AND phase = 'depth_measure') AS depth_correct, count(*) FILTER (truth = 'duct') AS duct_total,
  count(*) FILTER (truth = 'duct' AND phase = 'duct_laid') AS duct_correct,
  count(*) FILTER (truth = 'duct' AND phase IN ('duct_laid', 'sand_bedded', 'tape_laid')) AS duct_lenient
  FROM scores JOIN truth USING (photo_id) GROUP BY 1)"""

RECURSIVE = {"reach", "ch_reach"}
_WORD = re.compile(r"[a-z_]+")


def with_views(query: str) -> str:
    """``query`` behind the WITH clauses of the views it uses, directly or not."""
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(sql: str) -> None:
        for name in dict.fromkeys(_WORD.findall(sql)):
            if name in VIEWS and name not in needed and name not in open_names:
                open_names.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    clauses = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(needed) else ''}{clauses}\n{query}"

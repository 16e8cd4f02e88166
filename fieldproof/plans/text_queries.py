"""Text rules on whole columns."""

from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.functions import text as x
from fieldproof.functions.gate import uncached_input
from fieldproof.functions.numbers import exact_round
from fieldproof.operators.reports import masked_evidence as display_set
from fieldproof.plans import tables as t
from fieldproof.plans.catalog import query
from fieldproof.plans.coverage_queries import verdict_rows
from fieldproof.plans.oracle_views import QUALITY_SQL, listed, quote, rounded, tokens_sql


def _family_sql(name: str) -> str:
    stem = f"regexp_replace({name}, {quote(rules.FAMILY_EXTENSION)}, '\\1')"
    stem = f"regexp_replace({stem}, {quote(rules.FAMILY_COUNTER)}, '\\1')"
    return f"lower(trim(regexp_replace({stem}, {quote(rules.FAMILY_COPY)}, '', 'g')))"


FAMILY_SQL = _family_sql("filename")


@query("P1", "SELECT filename, bytes, photo_id FROM files")
def content_ids(spark, sf):
    return t.files(spark, sf).select("filename", "bytes", F.sha1("content").alias("photo_id"))


@query("P2", f"SELECT filename, {FAMILY_SQL} AS family FROM files")
def family_keys(spark, sf):
    return t.files(spark, sf).select("filename", x.family_key(F.col("filename")).alias("family"))


@query("P3", "SELECT photo_id, lat, lon FROM read_stamps")
def overlay_coordinates(spark, sf):
    return t.stamps(spark, sf).withColumn("at", x.overlay_coordinates(F.col("overlay_latlon"))).select("photo_id", "at.lat", "at.lon")


@query("P4", """SELECT c_custkey, c_acctbal / 60 AS lat, c_acctbal / 30 AS lon,
  c_acctbal / 60 BETWEEN -90 AND 90 AND c_acctbal / 30 BETWEEN -180 AND 180 AS valid FROM customer""")
def coordinate_range(spark, sf):
    lat, lon = F.col("c_acctbal") / 60, F.col("c_acctbal") / 30
    return t.read(spark, sf, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"), x.in_range(lat, lon).alias("valid"))


@query("P5", f"""SELECT photo_id, 'F' || nullif(regexp_extract(paper_label_code, {quote(rules.PAPER_LABEL_PATTERN)}, 1), '') AS f_code,
  'R' || nullif(regexp_extract(paper_label_code, {quote(rules.PAPER_LABEL_PATTERN)}, 2), '') AS r_code FROM stamps""")
def paper_labels(spark, sf):
    return t.stamps(spark, sf).withColumn("l", x.paper_label(F.col("paper_label_code"))).select("photo_id", "l.f_code", "l.r_code")


@query("P6", """SELECT segment_id, fcp_name AS f_code,
  array_to_string(list_filter(string_split_regex(upper(duct_main_short), '[\\^:]+'), lambda p: p <> ''), ',') AS r_codes FROM segments""")
def duct_codes(spark, sf):
    zone = F.concat(F.lower("fcp_name"), F.lit(" schacht"))
    return t.segments(spark, sf).select(
        "segment_id", x.leading_f_code(zone).alias("f_code"), F.array_join(x.r_code_tokens(F.col("duct_main_short")), ",").alias("r_codes"))


@query("P7", "SELECT segment_id, fcp_name AS zone FROM segments")
def zone_names(spark, sf):
    text = F.concat("fcp_name", F.lit(" ["), F.col("line_order").cast("string"), F.lit("] [x]"))
    return t.segments(spark, sf).select("segment_id", x.zone_name(text).alias("zone"))


@query("P8", f"SELECT photo_id, array_to_string({tokens_sql('overlay_address')}, ',') AS tokens FROM stamps")
def street_tokens(spark, sf):
    return t.stamps(spark, sf).select(
        "photo_id", F.array_join(F.array_sort(x.street_tokens(F.col("overlay_address"))), ",").alias("tokens"))


@query("P9", f"""SELECT address, road, len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) AS disagree
FROM (SELECT address, road, {tokens_sql("split_part(address, ',', 1)")} AS a, {tokens_sql("coalesce(road, '')")} AS b FROM geocode_cache)""")
def street_conflicts(spark, sf):
    street = F.substring_index("address", ",", 1)
    return t.geocode_cache(spark, sf).select("address", "road", x.streets_disagree(street, F.col("road")).alias("disagree"))


# One reason text per photo, in every wording that occurs.
_FORMS = [
    ("relevance=", "relevance"), ("phase=", "phase"),
    ("3x warning_tape_visible=", "warning_tape_visible"), ("2x 4x duct_visible=", "duct_visible"),
    ("sand_bedding_visible=", "sand_bedding_visible"),
]
_NUMBERED = [
    "snap_distance={}m", "density 1/{}m below 1/10m", "first compliant photo at meter {} (>5m from start)",
    "last compliant photo at meter {} (>5m from end of 90m)", "max gap {}m > 5m between meter 2 and meter 33",
    "{} personal-data photo(s)", "{} off-topic photo excluded", "lat/lon and printed address disagree by {}.5 km (off-cluster)",
    "lat/lon and printed address disagree by {} km", "2x duplicate photo reused on this segment {}",
    "tape_laid phase but orange tape {} not visible",
]
_PLAIN = [*rules.FIXED_ACTIONS, "no other photos"]
_COUNT = len(_FORMS) + len(_NUMBERED) + len(_PLAIN)


def _reason_text():
    options = [F.concat(F.lit(p), F.coalesce(c, F.lit("None"))) for p, c in _FORMS]
    options += [F.concat(F.lit(n.split("{}")[0]), (F.col("k") % 90).cast("string"), F.lit(n.split("{}")[1])) for n in _NUMBERED]
    options += [F.lit(p) for p in _PLAIN]
    chosen = F.get(F.array(*options), ((F.col("k") + F.col("part")) % _COUNT).cast("int"))
    return F.concat(chosen, F.lit(" ; "), F.get(F.array(*options), ((F.col("k") + F.col("supp") * 3) % _COUNT).cast("int")), F.lit(";"))


def _reason_sql() -> str:
    options = [f"{quote(p)} || coalesce({c}, 'None')" for p, c in _FORMS]
    options += [f"{quote(n.split('{}')[0])} || (k % 90) || {quote(n.split('{}')[1])}" for n in _NUMBERED]
    options += [quote(p) for p in _PLAIN]
    array = "[" + ", ".join(options) + "]"
    return f"{array}[(k + part) % {_COUNT} + 1] || ' ; ' || {array}[(k + supp * 3) % {_COUNT} + 1] || ';'"


def _sentence_sql(r: str) -> str:
    body = f"regexp_replace({r}, '^(\\d+x \\s*)+', '')"
    chain = body
    for pattern, sentence in rules.PATTERN_ACTIONS:
        for i in range(1, 5):
            sentence = sentence.replace(f"${i}", f"\\{i}")
        chain = f"regexp_replace({chain}, {quote(pattern)}, {quote(sentence)}, 'g')"
    fixed = " ".join(f"WHEN {body} = {quote(k)} THEN {quote(v)}" for k, v in rules.FIXED_ACTIONS.items())
    out = f"(CASE {fixed} ELSE {chain} END)"
    for code, friendly in rules.STAGE_NAMES.items():
        out = f"replace({out}, {quote(code)}, {quote(friendly)})"
    counts = f"regexp_replace(regexp_extract({r}, '^(?:\\d+x \\s*)+'), '(\\d+)x \\s*', '(\\1 photos) ', 'g')"
    return f"{counts} || {out}"


def _actions_sql(source: str) -> str:
    return f"""SELECT id, string_agg({_sentence_sql('r')}, ' ' ORDER BY i) AS action
FROM (SELECT id, trim(u.r) AS r, u.i AS i FROM (SELECT id, unnest(list_transform(string_split(txt, ';'), lambda v, n: {{'r': v, 'i': n}})) AS u FROM ({source})))
WHERE r <> '' GROUP BY 1"""


@query("P17", _actions_sql(source=f"SELECT photo_id AS id, {_reason_sql()} AS txt FROM photos"))
def action_texts(spark, sf):
    return t.photos(spark, sf).select(F.col("photo_id").alias("id"), x.action_text(_reason_text()).alias("action"))


@query("P17", f"""SELECT v.segment_id, coalesce(a.action, {quote(rules.EMPTY_REASONS_TEXT)}) AS action
FROM verdicts v LEFT JOIN ({_actions_sql(source="SELECT segment_id AS id, reasons AS txt FROM verdicts")}) a ON a.id = v.segment_id""")
def segment_actions(spark, sf):
    return verdict_rows(spark, sf).select("segment_id", x.action_text(F.col("reasons")).alias("action"))


@query("P18", "SELECT segment_id, CASE verdict WHEN 'RED' THEN 'Needs review' WHEN 'YELLOW' THEN 'Warning' WHEN 'GREEN' THEN 'Passing' END AS label FROM verdicts")
def verdict_labels(spark, sf):
    return verdict_rows(spark, sf).select("segment_id", x.verdict_label(F.col("verdict")).alias("label"))


@query("P19", """SELECT conv_id, turn, CASE WHEN length(s) > 500 THEN substr(s, 1, 500) || '…' ELSE s END AS shown FROM (
  SELECT conv_id, turn, replace(replace(regexp_replace(chr(7) || '<b>' || text || '</b>' || chr(127), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '<', '&lt;'), '>', '&gt;') AS s
  FROM conversations)""")
def scrubbed_text(spark, sf):
    raw = F.concat(F.lit("\x07<b>"), "text", F.lit("</b>\x7f"))
    return t.read(spark, sf, "conversations").select("conv_id", "turn", x.scrub(raw).alias("shown"))


@query("P20", f"""SELECT photo_id, personal_data_visible, {', '.join(f"CASE WHEN personal_data_visible <> 'yes' THEN {c} END AS {c}" for c in QUALITY_SQL if c not in ('overlay_address', 'personal_data_visible'))} FROM quality""")
def masked_evidence(spark, sf):
    return display_set(t.quality(spark, sf))


_MARKED = ["Authorization", "x-api-key", "sk-ant-", "429", "Bad Gateway", "invalid image"]


@query("P21", f"""SELECT event_id, substr(regexp_replace(regexp_replace(regexp_replace(m, '(?s)Authorization.*', '[Authorization redacted]'),
  '(?s)x-api-key.*', '[x-api-key redacted]'), '(?s)sk-ant-.*', '[sk-ant- redacted]'), 1, 300) AS message
FROM (SELECT event_id, event_type || ': ' || repeat(props, (event_id % 40)::INT) || {listed(_MARKED)}[event_id % 6 + 1] || ' x-api-key ' || user_id AS m FROM events)""")
def redacted_errors(spark, sf):
    marker = F.get(F.array(*map(F.lit, _MARKED)), (F.col("event_id") % 6).cast("int"))
    message = F.concat("event_type", F.lit(": "), F.repeat("props", (F.col("event_id") % 40).cast("int")), marker,
                       F.lit(" x-api-key "), F.col("user_id").cast("string"))
    return t.read(spark, sf, "events").select("event_id", x.redact_secrets(message).alias("message"))


@query("P22", f"""SELECT event_id, {' OR '.join(f"contains(m, {quote(k)})" for k in rules.TRANSIENT_MARKERS)} AS transient
FROM (SELECT event_id, lower(event_type || ' ' || {listed(_MARKED)}[event_id % 6 + 1] || ' ' || user_id) AS m FROM events)""")
def transient_failures(spark, sf):
    marker = F.get(F.array(*map(F.lit, _MARKED)), (F.col("event_id") % 6).cast("int"))
    message = F.concat_ws(" ", "event_type", marker, F.col("user_id").cast("string"))
    return t.read(spark, sf, "events").select("event_id", x.is_transient(message).alias("transient"))


@query("P23", f"""SELECT photo_id, model, {rounded('cost_usd', 6)} AS cost_usd, cost_nano, greatest(tok_in - tok_cache_r, 0) AS uncached FROM usage""")
def call_costs(spark, sf):
    return t.priced(t.usage(spark, sf)).select(
        "photo_id", "model", exact_round(F.col("cost_usd"), 6).alias("cost_usd"), "cost_nano",
        uncached_input(F.col("tok_in"), F.col("tok_cache_r")).alias("uncached"))


@query("P24", """SELECT model, CASE WHEN contains(model, 'haiku') THEN 'haiku' WHEN contains(model, 'sonnet') THEN 'sonnet' WHEN contains(model, 'opus') THEN 'opus'
  WHEN model = '' THEN 'unknown' ELSE model END AS family, n FROM (
  SELECT CASE event_id % 5 WHEN 0 THEN 'x-haiku-1' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'opus-9' WHEN 3 THEN '' ELSE event_type END AS model, count(*) AS n FROM events GROUP BY 1)""")
def model_families(spark, sf):
    r = F.col("event_id") % 5
    model = F.when(r == 0, "x-haiku-1").when(r == 1, "sonnet").when(r == 2, "opus-9").when(r == 3, "").otherwise(F.col("event_type"))
    counted = t.read(spark, sf, "events").groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("model", x.model_family(F.col("model")).alias("family"), "n")


@query("P25", """SELECT segment_id, segment_id AS report_id, split_part(segment_id, '_', 2) AS list_id FROM segments
UNION ALL SELECT 'SDIRouteSection_' || line_order || '_' || fcp_name, line_order || '_' || fcp_name, fcp_name FROM segments""")
def short_ids(spark, sf):
    s = t.segments(spark, sf)
    long = s.select(F.concat_ws("_", F.lit("SDIRouteSection"), F.col("line_order").cast("string"), "fcp_name").alias("segment_id"))
    sid = F.col("segment_id")
    return s.select("segment_id").unionByName(long).select("segment_id", x.report_id(sid).alias("report_id"), x.list_id(sid).alias("list_id"))


@query("P29", "SELECT segment_id, trim(split_part(reasons, ';', 1)) AS why FROM verdicts")
def first_reasons(spark, sf):
    return verdict_rows(spark, sf).select("segment_id", x.first_reason(F.col("reasons")).alias("why"))


@query("P30", "SELECT segment_id, reasons = 'no compliant photos snapped' AS untouched FROM verdicts")
def untouched_segments(spark, sf):
    return verdict_rows(spark, sf).select("segment_id", x.is_no_photos_only(F.col("reasons")).alias("untouched"))

"""Text rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldproof import rules


def strip_text(x: Column) -> Column:
    """Trim any leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def family_key(filename: Column) -> Column:
    """Name shared by re-submissions of one photo."""
    stem = F.regexp_replace(filename, rules.FAMILY_EXTENSION, "$1")
    stem = F.regexp_replace(stem, rules.FAMILY_COUNTER, "$1")
    stem = F.regexp_replace(stem, "(?u)" + rules.FAMILY_COPY, "")
    return F.lower(strip_text(stem))


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def in_range(lat: Column, lon: Column) -> Column:
    """Physically possible coordinate pair."""
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _position(readings: Column) -> Column:
    """struct(lat, lon) of two readings, one per axis and in range, else NULL."""
    def pair(r):
        lat = F.when(r[0]["is_lat"], r[0]["value"]).otherwise(r[1]["value"])
        lon = F.when(r[0]["is_lat"], r[1]["value"]).otherwise(r[0]["value"])
        both = (F.size(r) == 2) & (F.get(r, F.lit(0))["is_lat"] != F.get(r, F.lit(1))["is_lat"])
        return F.when(both, F.struct(lat.alias("lat"), lon.alias("lon")))

    return _once(_once(readings, pair), lambda at: F.when(in_range(at["lat"], at["lon"]), at))


def _reading(value: Column, hemisphere: Column) -> Column:
    sign = F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)
    return F.struct((value * sign).alias("value"), F.upper(hemisphere).isin("N", "S").alias("is_lat"))


def overlay_coordinates(raw: Column) -> Column:
    """struct(lat, lon) read from the stamp printed on a photo, or NULL.

    Three notations are tried in turn. A notation counts only if its first two
    readings give one latitude and one longitude in range.
    """
    text = F.translate(raw, "´′″ ", "''\" ")

    def first_two(pattern: str, groups: int) -> Column:
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
        return F.slice(F.arrays_zip(*found), 1, 2)

    dms = F.transform(first_two(rules.DMS_PATTERN, 4), lambda m: _reading(
        _number(m["0"]) + _number(m["1"]) / 60 + _number(m["2"]) / 3600, m["3"]))
    decimal = F.transform(
        first_two(rules.DECIMAL_HEMISPHERE_PATTERN, 2), lambda m: _reading(_number(m["0"]), m["1"]))
    labelled = F.transform(first_two(rules.DECIMAL_LABEL_PATTERN, 2), lambda m: F.struct(
        _number(m["1"]).alias("value"), F.lower(m["0"]).startswith("lat").alias("is_lat")))
    return F.coalesce(_position(dms), _position(decimal), _position(labelled))


def paper_label(code: Column) -> Column:
    """struct(f_code, r_code) of a paper label such as F170-R084-11-or, or NULL (P5)."""
    f_digits = F.regexp_extract(code, rules.PAPER_LABEL_PATTERN, 1)
    r_digits = F.regexp_extract(code, rules.PAPER_LABEL_PATTERN, 2)
    return F.when(
        f_digits != "",
        F.struct(
            F.concat(F.lit("F"), f_digits).alias("f_code"),
            F.concat(F.lit("R"), r_digits).alias("r_code"),
        ),
    )


def leading_f_code(zone: Column) -> Column:
    """F-code of a zone name, '' when it has none."""
    return F.upper(F.regexp_extract(F.coalesce(zone, F.lit("")), rules.LEADING_F_PATTERN, 1))


def r_code_tokens(composite: Column) -> Column:
    """Upper-cased parts of a composite duct code."""
    parts = F.split(F.upper(F.coalesce(composite, F.lit(""))), rules.R_CODE_SEPARATOR)
    return F.array_except(parts, F.array(F.lit("")))


def zone_name(description: Column) -> Column:
    """Zone code before its bracketed count."""
    return F.substring_index(description, " [", 1)


def _ascii_folding() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character, and that character."""
    sources, targets = [], []
    for code in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            sources.append(chr(code))
            targets.append(folded)
    return "".join(sources), "".join(targets)


_FOLD_FROM, _FOLD_TO = _ascii_folding()


def street_tokens(address: Column) -> Column:
    """Comparable street words, plus forms without 'strasse' (P8).

    Characters without an ASCII form are dropped, so 'ß' does not equal 'ss'.
    """
    folded = F.translate(F.coalesce(address, F.lit("")), _FOLD_FROM, _FOLD_TO)
    plain = F.lower(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))
    words = F.array_distinct(F.filter(F.split(plain, "[^a-z]+"), lambda w: F.length(w) > 2))
    shortened = F.transform(
        F.filter(words, lambda w: w.contains("strasse")),
        lambda w: F.replace(w, F.lit("strasse"), F.lit("")),
    )
    return F.array_union(words, shortened)


def streets_disagree(a: Column, b: Column) -> Column:
    """Both addresses name streets and share none."""
    left, right = street_tokens(a), street_tokens(b)
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)


def action_sentence(reason: Column) -> Column:
    """One reason code as an instruction for the crew."""
    trimmed = strip_text(reason)
    counts = F.regexp_extract(trimmed, r"^((?:\d+x \s*)+)(?=\S)", 1)
    body = F.substr(trimmed, F.length(counts) + 1)
    chained = body
    for pattern, sentence in rules.PATTERN_ACTIONS:
        chained = F.regexp_replace(chained, pattern, sentence)
    fixed = F.create_map(*[F.lit(v) for kv in rules.FIXED_ACTIONS.items() for v in kv])
    sentence = F.coalesce(F.element_at(fixed, body), chained)
    for code, friendly in rules.STAGE_NAMES.items():
        sentence = F.replace(sentence, F.lit(code), F.lit(friendly))
    return F.concat(F.regexp_replace(counts, r"(\d+)x \s*", "($1 photos) "), sentence)


def action_text(reasons: Column) -> Column:
    """A ';'-joined reasons field as one instruction text."""
    parts = F.filter(
        F.transform(F.split(reasons, ";"), strip_text), lambda part: part != ""
    )
    text = F.array_join(F.transform(parts, action_sentence), " ")
    return F.when(F.coalesce(reasons, F.lit("")) == "", F.lit(rules.EMPTY_REASONS_TEXT)).otherwise(text)


def verdict_label(verdict: Column) -> Column:
    """Display label of a verdict."""
    labels = F.create_map(*[F.lit(v) for kv in rules.VERDICT_LABELS.items() for v in kv])
    return F.element_at(labels, verdict)


def scrub(text: Column) -> Column:
    """Control characters out, angle brackets escaped, length capped."""
    clean = F.regexp_replace(text, rules.CONTROL_CHARACTERS, "")
    clean = F.replace(clean, F.lit("<"), F.lit("&lt;"))
    clean = F.replace(clean, F.lit(">"), F.lit("&gt;"))
    return F.when(
        F.length(clean) > rules.TEXT_CAP,
        F.concat(F.substring(clean, 1, rules.TEXT_CAP), F.lit("…")),
    ).otherwise(clean)


def redact_secrets(message: Column) -> Column:
    """Error text cut at the first secret marker."""
    for marker in rules.SECRET_MARKERS:
        message = F.regexp_replace(message, f"(?s){marker}.*", f"[{marker} redacted]")
    return F.substring(message, 1, rules.ERROR_CAP)


def is_transient(message: Column) -> Column:
    """The failure is worth another attempt."""
    return F.lower(message).rlike("|".join(rules.TRANSIENT_MARKERS))


def model_family(model: Column) -> Column:
    """Short family name of a model id."""
    m = F.coalesce(model, F.lit(""))
    return (
        F.when(m.contains("haiku"), "haiku").when(m.contains("sonnet"), "sonnet")
        .when(m.contains("opus"), "opus").when(m == "", "unknown").otherwise(m)
    )


def report_id(segment_id: Column) -> Column:
    """Segment id without the long known prefix (P25)."""
    return F.regexp_replace(segment_id, "^" + rules.SHORT_ID_PREFIX, "")


def list_id(segment_id: Column) -> Column:
    """Last underscore part of a segment id (P25)."""
    return F.substring_index(segment_id, "_", -1)


def first_reason(reasons: Column) -> Column:
    """First of a ';'-joined reasons field."""
    return strip_text(F.substring_index(F.coalesce(reasons, F.lit("")), ";", 1))


def is_no_photos_only(reasons: Column) -> Column:
    """The only complaint is that nothing was photographed."""
    return strip_text(F.coalesce(reasons, F.lit(""))).isin(rules.NO_PHOTO_REASONS)


def phash_bits(phash: Column) -> Column:
    """16 hex digits as 64 bits; the top digit may set the sign. Anything else is NULL."""
    return F.when(phash.rlike("^[0-9a-fA-F]{16}$"), F.conv(phash, 16, -10).cast("bigint"))

"""Secret scans that link the parts of a credential: access identifiers, secrets, endpoints.

Base kinds (``assign``, ``access``, ``hex``) speak for themselves. Weak kinds do
not: a login name, a long mixed token or an address is a candidate, which is
reported only where the parts that complete it stand in the same scope and in
reach: a name near a secret, a token near an identifier, an address near both.
A scope is a block of text between blank lines.

Matches are found by Spark's own regular expressions; a start is the running sum
of the lengths between and of the matches before it. Scopes are counted along the
matches of one document. Parts meet in an interval join on (document, scope, bin
of REACH characters), so its rows follow the text's length. Texts are read once;
what is shuffled are matches.

Defined cases: null and empty texts have no spans; every row is judged by itself,
with repeated or null ids too; a candidate that overlaps a base span is part of
it and not reported; offsets are code points, ends exclusive; texts count whole,
whatever their length; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.llm.common import whole_text
from fieldproof.session import cut_lineage

#: Code points that may lie between the parts of one credential.
REACH = 500
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """A pattern, the role of what it finds, and what a match must have.

    ``group`` must have ``least`` characters and match all of ``has``; ``needs``
    names the roles that complete a weak kind.
    """

    name: str
    role: str
    pattern: str
    least: int
    group: int = 0
    has: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


_TO_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: In the order in which spans of equal start are listed.
KINDS = (
    Kind("assign", SECRET, rf"(?i:(password|passwd|secret|token|api_?key)){_TO_VALUE}([A-Za-z0-9+/_.=-]+)", 6, 2),
    # A run of a class is matched whole or not at all, so the least length can stand in the pattern.
    Kind("access", IDENTIFIER, r"AKIA[A-Z0-9]{16,}", 20),
    Kind("hex", SECRET, r"[0-9a-f]{24,}", 24),
    Kind("user", IDENTIFIER, rf"(?i:(user_?name|user_?id|login|client_?id|access_?key_?id)){_TO_VALUE}([A-Za-z0-9@._-]+)", 3, 2, needs=(SECRET,)),
    Kind("key", SECRET, r"[A-Za-z0-9+/]{40,}", 40, has=("[0-9]", "[A-Z]", "[a-z]"), needs=(IDENTIFIER,)),
    Kind("endpoint", ENDPOINT, r"""(?i:https?|ftps?|sftp|ssh|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|rediss?|amqps?|ldaps?)://[^\x20\x09-\x0D"'<>]+""", 8, needs=(IDENTIFIER, SECRET)),
)
BREAK = r"\n[\x20\x09\x0D]*\n"
_MATCH = "array<struct<kind: int, no: int, before: int, size: int, ok: boolean, value: string>>"


def _found(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group))


def _matches(number: int, kind: Kind | None) -> Column:
    """Every match of a kind with the characters between the match before and it."""
    pattern, whole = (kind.pattern if kind else BREAK), F.col(f"m{number}")
    value = whole if kind is None or kind.group == 0 else _found(pattern, kind.group)
    rows = F.arrays_zip(
        F.transform(F.split("text", pattern, -1), F.length).alias("before"),
        F.transform(whole, F.length).alias("size"), value.alias("value"),
    )

    def row(r: Column, no: Column) -> Column:
        ok = F.lit(True)
        if kind:
            for test in (F.length(r["value"]) >= kind.least, *(r["value"].rlike(x) for x in kind.has)):
                ok = ok & test
        return F.struct(
            F.lit(number).alias("kind"), no.alias("no"), r["before"].alias("before"), r["size"].alias("size"),
            ok.alias("ok"), (r["value"] if kind else F.lit("")).alias("value"),
        )

    # The piece behind the last match has no match of its own.
    listed = F.transform(F.slice(rows, F.lit(1), F.size(whole)), row)
    return F.when(F.size(whole) > 0, listed).otherwise(F.array().cast(_MATCH))


def _placed(docs: DataFrame) -> DataFrame:
    """uid, doc_id, weak, kind, scope, start, end, value: a row per match, and one without kind per document."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", whole_text("text").alias("text"))
    found = texts.select("*", *(_found(k.pattern).alias(f"m{i}") for i, k in enumerate(KINDS)))
    weak = F.lit(False)
    for i, k in enumerate(KINDS):
        weak = weak | (F.size(f"m{i}") > 0) if k.needs else weak
    # Scopes matter only where a candidate waits for its other parts.
    none = F.array().cast("array<string>")
    found = found.withColumn("weak", weak).withColumn(f"m{len(KINDS)}", F.when(F.col("weak"), _found(BREAK)).otherwise(none))
    itself = F.array(F.lit(None).cast(_MATCH[6:-1]))
    listed = F.concat(itself, *(_matches(i, k) for i, k in enumerate((*KINDS, None))))
    # Written once: the numbers of the rows stay as they are whichever task is run again.
    rows = cut_lineage(found.select("uid", "doc_id", "weak", F.explode(listed).alias("m")).select("uid", "doc_id", "weak", "m.*"))
    dealt = rows.repartition("uid")
    along = Window.partitionBy("uid", "kind").orderBy("no")
    start = F.sum("before").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    breaks = F.count_if(F.col("kind") == len(KINDS)).over(
        Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    return (
        dealt.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.col("size")).cast("int"))
        .withColumn("scope", breaks)
        .filter((F.col("ok") & (F.col("kind") < len(KINDS))) | F.col("kind").isNull())
        .select("uid", "doc_id", "weak", "kind", "scope", "start", "end", "value")
    )


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k.role) for k in KINDS)), kind + 1)


def _bins(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / REACH), F.floor((high - 1) / REACH)))


def _linked(placed: DataFrame) -> DataFrame:
    """uid, kind, start and the nearest partner of each role for every weak candidate that is complete."""
    strong = F.element_at(F.array(*(F.lit(not k.needs) for k in KINDS)), F.col("kind") + 1)
    parts = placed.filter("weak AND kind IS NOT NULL").withColumn("strong", strong)
    ask = parts.filter(~F.col("strong")).select(
        "uid", "scope", "kind", "start", "end", _bins(F.col("start") - REACH, F.col("end") + REACH).alias("bin"))
    give = parts.select(
        "uid", "scope", _bins(F.col("start"), F.col("end")).alias("bin"), F.col("kind").alias("p_kind"),
        F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("strong").alias("p_strong"))
    apart = F.greatest(F.col("p_start") - F.col("end"), F.col("start") - F.col("p_end"))
    met = ask.join(give, ["uid", "scope", "bin"]).withColumn("apart", apart)
    partner = F.struct(F.col("apart"), F.col("p_start").alias("start"), F.col("p_kind").alias("kind"), F.col("p_end").alias("end"))
    usable = (F.col("apart") >= 0) & (F.col("apart") <= REACH)
    nearest = {r: F.min(F.when(usable & (_role(F.col("p_kind")) == r), partner)).alias(r) for r in (IDENTIFIER, SECRET, ENDPOINT)}
    near = met.groupBy("uid", "kind", "start").agg(F.max((F.col("apart") < 0) & F.col("p_strong")).alias("inside"), *nearest.values())
    complete = F.lit(False)
    for i, k in enumerate(KINDS):
        if k.needs:
            whole = F.col("kind") == i
            for role in k.needs:
                whole = whole & F.col(role).isNotNull()
            complete = complete | whole
    return near.filter(~F.col("inside") & complete).drop("inside")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` of every row: kind, start, end, value, and the partners of weak ones.

    Spans go by start, then by the order of KINDS. A partner is the nearest part
    of a role in scope and reach, with the characters between.
    """
    placed = cut_lineage(_placed(docs))
    linked = _linked(placed)
    names = F.array(*(F.lit(k.name) for k in KINDS))
    kept = placed.join(linked, ["uid", "kind", "start"], "left")
    weak = F.element_at(F.array(*(F.lit(bool(k.needs)) for k in KINDS)), F.col("kind") + 1)
    complete = F.coalesce(IDENTIFIER, SECRET, ENDPOINT).isNotNull()

    def partner(role: str) -> Column:
        p = F.col(role)
        return F.when(p.isNotNull(), F.struct(F.element_at(names, p["kind"] + 1).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["apart"].alias("apart")))

    span = F.struct(
        F.col("start"), F.col("kind").alias("no"), F.col("end"), F.element_at(names, F.col("kind") + 1).alias("kind"), F.col("value"),
        F.array_compact(F.array(*(partner(r) for r in (IDENTIFIER, SECRET, ENDPOINT)))).alias("partners"))
    listed = F.collect_list(F.when(F.col("kind").isNotNull() & (~weak | complete), span))
    return kept.groupBy("uid", "doc_id").agg(F.sort_array(listed).alias("spans")).drop("uid")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their spans' digest, and all spans as one string."""
    strong = [i for i, k in enumerate(KINDS) if not k.needs]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["no"] == i)).cast("long").alias(f"n_{KINDS[i].name}")
    base = F.filter("spans", lambda s: s["no"].isin(strong))
    return found.select("doc_id", *(count(i) for i in strong), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same rows from DuckDB: matches and pieces by its own expressions, partners by a plain join in scope."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    tests = lambda k: " AND ".join([f"length(v) >= {k.least}", *(f"regexp_matches(v, {quote(x)})" for x in k.has)])
    one = """
  SELECT uid, {i} AS k, no, {role} AS role, {strong} AS strong, ({ok}) AS ok,
    (list_sum(list_transform(s[1:no], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:no - 1], lambda x: length(x))), 0))::BIGINT AS st, length(m[no])::BIGINT AS n
  FROM (SELECT uid, m, s, unnest(range(1, len(m) + 1)) AS no, unnest(g) AS v FROM (
    SELECT uid, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS s FROM d))"""
    parts = "UNION ALL".join(
        one.format(i=i, role=quote(k.role), strong=not k.needs, ok=tests(k), p=quote(k.pattern), group=k.group) for i, k in enumerate(KINDS))
    breaks = one.format(i=len(KINDS), role="''", strong=False, ok="true", p=quote(BREAK), group=0)
    needs = " OR ".join(f"(k = {i} AND {' AND '.join(k.needs)})" for i, k in enumerate(KINDS) if k.needs)
    names = "[" + ", ".join(quote(k.name) for k in KINDS) + "]"
    joined = lambda where: f"coalesce(string_agg({names}[k + 1] || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{k.name}" for i, k in enumerate(KINDS) if not k.needs)
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({parts}),
b AS (SELECT uid, st FROM ({breaks})),
s AS (SELECT f.uid, k, role, strong, f.st, f.st + n AS en, (SELECT count(*) FROM b WHERE b.uid = f.uid AND b.st <= f.st) AS scope FROM f WHERE ok),
w AS (
  SELECT uid, k, st, en, bool_or(p_role = 'identifier' AND gap BETWEEN 0 AND {REACH}) AS identifier,
    bool_or(p_role = 'secret' AND gap BETWEEN 0 AND {REACH}) AS secret, bool_or(p_strong AND gap < 0) AS inside
  FROM (SELECT a.*, p.role AS p_role, p.strong AS p_strong, greatest(p.st - a.en, a.st - p.en) AS gap
        FROM s a JOIN s p USING (uid, scope) WHERE NOT a.strong)
  GROUP BY uid, k, st, en),
k AS (SELECT uid, k, st, en FROM s WHERE strong UNION ALL SELECT uid, k, st, en FROM w WHERE NOT inside AND ({needs})),
g AS (SELECT d.doc_id, {counts}, sha256({joined('strong')}) AS base_sha256, {joined('k IS NOT NULL')} AS spans
  FROM d LEFT JOIN (SELECT *, k < {sum(not k.needs for k in KINDS)} AS strong FROM k) USING (uid) GROUP BY d.uid, d.doc_id)
SELECT * FROM g"""


SQL = _sql()

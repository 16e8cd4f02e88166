"""Merkle dataset manifest as a persistent tree: tampered leaves make versions that copy their path only.

Rows become digests in the scan. Their places within a group come from a range
exchange and running counts, never from a window over a group. BLOCK aligned
leaves are a block; its nodes are built in one task, its top is a leaf of the
next tier, and so on until every group has one block; subroots are a tree of the
same make. Then the siblings above each block travel down, tier by tier, in
tables of one row per block. A tampered leaf is a version: within its block it
copies its ancestors and shares every other node with the base, and it goes on
above the block along those siblings, in the task of its own block. No task holds
more than a block, whatever the size of a group.

Defined cases: a null value is ``-`` in its leaf; null groups are a group and come
first; null order keys come first; rows of equal key go by leaf digest, and equal
leaves are leaves of their own; a null id is never tampered; a table without rows
gives none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.session import cut_lineage

LEVELS = 8
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """Digest of a row: each field's UTF-8 byte count, a colon and the field, or ``-``."""
    texts = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp, ...) with ``at``, the place within grp from 0 by ``order``, and ``n``, the group's size.

    Rows are dealt by range, so a group of any size is on many tasks; a task
    counts along its own rows and the counts of the tasks before are added.
    """
    names = [f.name for f in rows.schema.fields]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers: list[range] = []
            runs = pc.run_end_encode(batch.column("grp"))
            begin = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                so_far = so_far if value == last else 0
                numbers.append(range(so_far, so_far + end - begin))
                last, so_far, begin = value, so_far + end - begin, end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([i for r in numbers for i in r], pa.int64()), pa.array([part] * batch.num_rows, pa.int32())], [*names, "no", "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    keys = ["grp", *order]
    counts = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(counted, f"{schema}, no long, part int"))
    sizes = counts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("size"))
    along = Window.partitionBy("grp").orderBy("part")
    before = sizes.select(
        "grp", "part", (F.sum("size").over(along) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy("grp")).alias("n"))
    return counts.join(before, ["grp", "part"]).withColumn("at", F.col("before") + F.col("no")).drop("no", "part", "before")


def levels_of(leaves: list[str], n: int) -> list[list[str]]:
    """Nodes of a block level by level, leaves first; ``n`` is the size of the whole group.

    A block of a larger group goes up all LEVELS, so that its top stands at the
    height where the group's blocks meet; a group of one block stops at one node.
    """
    out = [leaves]
    while len(out) <= LEVELS if n > BLOCK else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def steps(levels: list[list[str]], at: int) -> list[str]:
    """Siblings of a leaf going up: ``<`` or ``>`` and the node to its left or right, or nothing."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append("" if other >= len(nodes) else ("<" if other < at else ">") + nodes[other])
        at >>= 1
    return out


def copied(node: str, path: list[str]) -> list[str]:
    """The ancestors that a changed leaf copies; all other nodes are the base's."""
    out = []
    for step in path:
        node = digest((step[1:], node) if step[:1] == "<" else (node, step[1:]))
        out.append(node)
    return out


def _tier(nodes: DataFrame, members: list[str]) -> DataFrame:
    """Blocks of ``nodes`` (grp, at, n, digest, ...): grp, at, n of the next tier, size, rows, digest."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [levels_of([r["digest"] for r in rows], n)[-1][0] for rows, n in zip(batch.column("rows").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "digest"])

    row = F.struct("at", "digest", *members)
    grouped = (
        nodes.groupBy("grp", F.col("n").alias("size"), F.shiftright("at", LEVELS).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select("grp", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).alias("n"), "size", "rows")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema.fields)
    return cut_lineage(grouped.mapInArrow(build, f"{schema}, digest string"))


def tree(nodes: DataFrame, members: list[str]) -> list[DataFrame]:
    """The tiers of blocks above ``nodes``; in the last one every group is one block."""
    tiers = [_tier(nodes, members)]
    while (tiers[-1].agg(F.max("n").alias("n")).first().n or 1) > 1:
        tiers.append(_tier(tiers[-1].select("grp", "at", "n", "digest"), []))
    return tiers


def _below(blocks: DataFrame) -> DataFrame:
    """grp, at, path of every node in ``blocks`` (grp, size, rows, path): its siblings there and above."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, size, rows, path in zip(*(batch.column(c).to_pylist() for c in ("grp", "size", "rows", "path"))):
                levels = levels_of([r["digest"] for r in rows], size)
                paths = [steps(levels, i) + path for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(rows), pa.string()), pa.array([r["at"] for r in rows], pa.int64()), pa.array(paths, pa.list_(pa.string()))], ["grp", "at", "path"])

    return blocks.select("grp", "size", "rows", "path").mapInArrow(spread, "grp string, at long, path array<string>")


def with_paths(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest blocks with ``path``, the siblings from their top to the end of ``top``'s paths (grp, path)."""
    blocks = tiers[-1].join(top, "grp")
    for lower in reversed(tiers[:-1]):
        blocks = lower.join(cut_lineage(_below(blocks)), ["grp", "at"])
    return blocks


def audit(
    docs: DataFrame, changes: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang",
    order: str = "doc_id", with_nodes: bool = False,
) -> DataFrame:
    """Digests and proof of every row, and the root of its version.

    ``changes`` gives the tampered value of a field; a row whose leaf it leaves
    alone belongs to the base version. Columns: ``order``, leaf, subroot, root,
    proof_sha256 (of the siblings up to the root), changed_leaf, folded_root,
    verified; ``with_nodes`` adds siblings and copied (the version's own nodes).
    """
    tampered = [(changes or {}).get(f, F.col(f)) for f in fields]
    # '' stands for null and sorts before every '=...', as UTF-8 does.
    rows = cut_lineage(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(order).alias("key"),
        leaf(F.col(f) for f in fields).alias("digest"), leaf(tampered).alias("changed")).withColumn("no_of_row", F.monotonically_increasing_id()))
    nodes = placed(rows, ["key", "digest", "no_of_row"])
    tiers = tree(nodes, ["key", "changed"])
    subroots = tiers[-1].select(F.col("grp").alias("key"), F.lit("all").alias("grp"), "digest")
    above = tree(placed(subroots, ["key"]), ["key"])
    empty = F.array().cast("array<string>")
    last = above[-1].select("grp", F.col("digest").alias("root"))
    highest = with_paths(above, last.select("grp", empty.alias("path")))
    members = highest.select("grp", F.explode("rows").alias("r")).select("grp", "r.at", F.col("r.key").alias("of"), F.col("r.digest").alias("subroot"))
    top = cut_lineage(
        members.join(_below(highest), ["grp", "at"]).join(last, "grp").select(F.col("of").alias("grp"), "path", "subroot", "root"))
    blocks = with_paths(tiers, top.select("grp", "path")).join(top.select("grp", "subroot", "root"), "grp")
    read = ["size", "rows", "path", "subroot", "root"]
    kind = rows.schema["key"].dataType.simpleString()
    nodes_of = ", siblings array<string>, copied array<string>" if with_nodes else ""
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, changed_leaf string, folded_root string{nodes_of}"

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("rows").values.field("key") if batch.num_rows else None
            for i, (size, rows, path, subroot, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in read))):
                levels = levels_of([r["digest"] for r in rows], size)
                out: list[tuple] = []
                for at, row in enumerate(rows):
                    siblings = steps(levels, at) + path
                    own = copied(row["changed"], siblings)
                    proof = digest(s[1:] for s in siblings)
                    folded = own[-1] if own else row["changed"]
                    more = (siblings, own if row["changed"] != row["digest"] else []) if with_nodes else ()
                    out.append((row["digest"], subroot, root, proof, row["changed"], folded, *more))
                begin = batch.column("rows").offsets[i].as_py() - batch.column("rows").offsets[0].as_py()
                columns = [pa.array(list(c), pa.list_(pa.string()) if j > 5 else pa.string()) for j, c in enumerate(zip(*out))]
                names = ["key", "leaf", "subroot", "root", "proof_sha256", "changed_leaf", "folded_root", "siblings", "copied"]
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(rows)), *columns], names[:len(columns) + 1])

    found = blocks.select(*read).mapInArrow(prove, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.withColumnRenamed("key", order)


def manifest(docs: DataFrame) -> DataFrame:
    """The contract's digest: a character is added to the count of every document whose crc32 7 divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    grown = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return audit(docs, {"n_chars": grown}).drop("changed_leaf")


def _sql() -> str:
    """The same rows from DuckDB: levels by recursion, proofs by following one sibling a level."""
    field = lambda x: f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')"
    row = lambda n: "sha256(" + " || ".join(field(x) for x in ("doc_id::VARCHAR", "source", "lang", f"({n})::VARCHAR", "text")) + ")"
    # Bits of a byte are shifted out one by one; 3988292384 is the reversed polynomial of CRC-32.
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: "
        "[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)")
    climb = """
  SELECT lvl + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {t} WHERE n > 1 GROUP BY lvl, g, pos // 2, n"""
    fold = """
  SELECT f.uid, f.g, f.lvl + 1, f.pos // 2, f.proof || coalesce(s.h, ''),
    sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END)
  FROM {f} f JOIN (SELECT DISTINCT lvl, g, n FROM {t}) w ON w.lvl = f.lvl AND w.g = f.g AND w.n > 1
  LEFT JOIN {t} s ON s.lvl = f.lvl AND s.g = f.g AND s.pos = xor(f.pos, 1)"""
    last = "(SELECT * FROM {f} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY lvl DESC) = 1)"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce('=' || lang, '') AS g, {row('n_chars')} AS leaf,
    {row(f"n_chars + CASE WHEN {crc} % 7 = 0 THEN 1 ELSE 0 END")} AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, uid) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS lvl, g, pos, leaf AS h, n FROM p UNION ALL {climb.format(t='t')}),
r AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, '' AS g, pos, h, n FROM r UNION ALL {climb.format(t='u')}),
f AS (SELECT uid, g, 0 AS lvl, pos, '' AS proof, changed AS h FROM p UNION ALL {fold.format(f='f', t='t')}),
v AS (SELECT f.uid, '' AS g, 0 AS lvl, r.pos, f.proof, f.h FROM {last.format(f='f')} f JOIN r USING (g) UNION ALL {fold.format(f='v', t='u')}),
q AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, r.h AS subroot, q.root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = q.root AS verified
FROM p JOIN r USING (g) JOIN {last.format(f='v')} v ON v.uid = p.uid CROSS JOIN q"""


SQL = _sql()

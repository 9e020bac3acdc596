r"""Merkle dataset manifest: aligned blocks as persistent trees, their upper levels as tables.

A row's leaf is the SHA-256 of its fields.  Leaves of a group stand in order;
every ``ARITY`` consecutive nodes become their digest, level by level, until one
node, the subroot, remains; subroots, in order of their groups, likewise give the
root.  Digests are lower-case hex, and are concatenated as such.

Places are exact and nothing is sorted in one task: Spark deals the leaves by
ranges, a range's first place is the number of leaves before it, and ranges of a
group are as many as there are partitions.  ``BLOCK`` = ARITY ** DEPTH leaves at aligned places are a block, a
subtree that one task holds.  A block's nodes never change: a tampered leaf makes
a new version of the block's root, which copies the node's ancestors and shares
all other nodes with the first version (``changed``).  Above the blocks, whose number is the leaves' by BLOCK,
each level is a table of runs, from which each block gets the siblings on its way
to the root; its versions go on along them, copying one node a level, in whatever
task the block is.

Defined results: null fields are ``-``; null groups come first, null ids first in
their group; rows of equal group and id stand in order of their leaves, and equal rows share a
leaf and stand side by side; a group of one row is its own subroot, one group's
subroot is the root; an empty table gives an empty table; other columns are not
part of a leaf and are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, table

#: Children of a node; levels and leaves of a block.
ARITY, DEPTH = 8, 4
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field's length in bytes and value, ``-`` where it's null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(df: DataFrame, by: list[str], order: list[str], tables: list) -> DataFrame:
    """df with place: its number from 0 in its group, in order; a table of the shared folder."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(spread, "spread", tables)
    # the number is the partition's, then the row's in it
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*by, "_part", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_shift"))
    return rows.join(parts, [*by, "_part"]).withColumn("place", F.col("_at") - F.col("_shift")).drop("_at", "_part", "_shift")


# --- one block


def digest(run) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def grown(leaves: list[str], levels: int) -> tuple:
    """The root of a tree of leaves, so many levels above them; a node is its digest and its children."""
    nodes = [(x, ()) for x in leaves]
    for _ in range(levels):
        runs = [tuple(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        nodes = [(digest(c[0] for c in run), run) for run in runs]
    return nodes[0]


def changed(node: tuple, place: int, levels: int, new: str) -> tuple:
    """A version of the tree with another leaf at a place: copies of its ancestors, which share all other nodes."""
    if not levels:
        return (new, ())
    under = ARITY ** (levels - 1)
    i = place // under
    kids = node[1]
    kids = (*kids[:i], changed(kids[i], place % under, levels - 1, new), *kids[i + 1 :])
    return (digest(c[0] for c in kids), kids)


def siblings(node: tuple, place: int, levels: int) -> list[tuple[str, str]]:
    """Digests left and right of the path from a leaf, from the leaf up."""
    out = []
    for level in range(levels - 1, -1, -1):
        i, place = divmod(place, ARITY**level)
        out.append(("".join(c[0] for c in node[1][:i]), "".join(c[0] for c in node[1][i + 1 :])))
        node = node[1][i]
    return out[::-1]


def folded(start: str, path) -> str:
    """The digest that a node and the siblings of its path lead to."""
    for left, right in path:
        start = digest((left, start, right))
    return start


# --- the levels above blocks

RUNG = "array<struct<left:string,right:string>>"


def climb(nodes: DataFrame, tables: list) -> DataFrame:
    """group, place, path, top of nodes (group, place, digest, n: nodes of the group): siblings up to the group's one node, and its digest.

    Each level is a table, an ARITY-th of the one below.
    """
    levels = []
    now, n = nodes, nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        runs = now.groupBy("group", F.expr(f"place div {ARITY}").alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
        levels.append(stored(runs, "level", tables))
        joined = F.array_join(F.col("run.digest"), "")
        now = levels[-1].select("group", F.col("up").alias("place"), F.when(F.col("n") > 1, F.sha2(joined, 256)).otherwise(joined).alias("digest"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        n = -(-n // ARITY)
    paths = now.select("group", "place", F.expr(f"CAST(array() AS {RUNG})").alias("path"), F.col("digest").alias("top"))
    for runs in reversed(levels):
        above = paths.withColumnRenamed("place", "up")
        left, right = "array_join(slice(run.digest, 1, i), '')", "array_join(slice(run.digest, i + 2, size(run)), '')"
        here = runs.select("group", "up", "n", "run", F.posexplode("run.place").alias("i", "place"))
        rung = F.expr(f"CASE WHEN n > 1 THEN array(struct({left} AS left, {right} AS right)) ELSE array() END")
        paths = here.select("group", "up", "place", rung.alias("rung")).join(above, ["group", "up"]).select("group", "place", F.concat("rung", "path").alias("path"), "top")
    return paths


GROUPED = T.StructType().add("group", "long").add("block", "long").add("digest", "string")
AUDIT = T.StructType().add("id", "long").add("leaf", "string").add("subroot", "string").add("root", "string").add("proof_sha256", "string").add("folded_root", "string")


def block_roots(leaves: DataFrame) -> DataFrame:
    """group, block, digest of leaves (group, block, place, n, leaf)."""

    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("place")
        root = grown(rows.column("leaf").to_pylist(), min(DEPTH, height(rows.column("n")[0].as_py())))
        return pa.table({"group": [key[0].as_py()], "block": [key[1].as_py()], "digest": [root[0]]})

    return leaves.select("group", "block", "place", "n", "leaf").groupBy("group", "block").applyInArrow(run, GROUPED)


def audited(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """AUDIT of leaves (group, block, place, n, id, leaf, now): now is the leaf that the row has today, folded with the siblings of the manifest."""

    def run(rows, way):
        import pyarrow as pa

        rows = rows.sort_by("place")
        leaf, now = rows.column("leaf").to_pylist(), rows.column("now").to_pylist()
        levels = min(DEPTH, height(rows.column("n")[0].as_py()))
        first = grown(leaf, levels)
        upper = [(s["left"], s["right"]) for s in way.column("path")[0].as_py()]
        beyond = "".join(a + b for a, b in upper)
        proof, root = [], []
        for i, (old, new) in enumerate(zip(leaf, now)):
            lower = siblings(first, i, levels)
            proof.append(digest((*(a + b for a, b in lower), beyond)))
            # a tampered leaf makes a version of the block; the upper levels go on from its root
            top = changed(first, i, levels, new)[0] if new != old else folded(old, lower)
            root.append(folded(top, upper))
        same = {c: pa.array([way.column(c)[0].as_py()] * len(leaf), pa.string()) for c in ("subroot", "root")}
        return pa.table({"id": rows.column("id"), "leaf": leaf, **same, "proof_sha256": proof, "folded_root": root})

    key = ["group", "block"]
    left = leaves.select("group", "block", "place", "n", "id", "leaf", "now").groupBy(*key)
    return left.cogroup(paths.select("group", "block", "path", "subroot", "root").groupBy(*key)).applyInArrow(run, AUDIT)


def manifest(docs: DataFrame, changed_leaf: Column, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS) -> DataFrame:
    """AUDIT of every row of docs: its leaf, the roots above it, the digest of its siblings, and the root that changed_leaf leads to with them."""
    tables: list = []
    # '0' for null, so that null comes first and groups compare by bytes
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in fields]).alias("leaf"), changed_leaf.alias("now"))
    placed = numbered(rows, ["key"], ["id", "leaf", "now"], tables)
    groups = stored(placed.groupBy("key").agg(F.count("*").alias("n")), "groups", tables)
    groups = stored(numbered(groups, [], ["key"], tables).withColumnRenamed("place", "group"), "groups", tables)
    leaves = stored(placed.join(groups, "key").select("group", F.expr(f"place div {BLOCK}").alias("block"), "place", "n", "id", "leaf", "now"), "leaves", tables)
    blocks = block_roots(leaves)
    blocks = blocks.join(groups.select("group", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n")), "group").select("group", F.col("block").alias("place"), "digest", "n")
    lower = stored(climb(stored(blocks, "blocks", tables), tables), "paths", tables)
    tops = lower.where("place = 0").select(F.lit(0).cast("long").alias("group"), F.col("group").alias("place"), F.col("top").alias("digest"), F.lit(groups.count()).cast("long").alias("n"))
    upper = stored(climb(tops, tables), "roots", tables).select(F.col("place").alias("group"), F.col("path").alias("above"), F.col("top").alias("root"))
    paths = lower.join(upper, "group").select("group", F.col("place").alias("block"), F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root")
    done = stored(audited(leaves, paths), "audit")
    discard(*tables)
    return done


def tampered() -> Column:
    """The contract's changed leaf: where 3 divides crc32 of the id, the text's A-Z are lower-cased."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(hit, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    return leaf(*[F.col(c) for c in FIELDS[:-1]], text)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    df = manifest(table(spark, sf_dir, "documents").select(*FIELDS), tampered())
    return df.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, leaves: str) -> str:
    """A recursive table of all nodes (g, l, i, d, n) above leaves (g, i, d, n)."""
    return f"""{name} AS (SELECT g, 0 AS l, i, d, n FROM {leaves}
      UNION ALL SELECT g, l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY g, l, i // 8)"""


_FIELDS = " || ".join("coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')".format(c) for c in FIELDS[:-1])
_LEAF = "sha256({} || coalesce(strlen({}) || ':' || {}, '-'))"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(4294967295, list_reduce([4294967295] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
  lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS BIGINT) FOR k IN range(8)], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))))"""

#: Leaf by leaf through recursive tables of whole levels; nothing is shared, no blocks.
OP11_SQL = f"""WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(_FIELDS, "text", "text")} AS leaf,
    CASE WHEN ({_CRC}) % 3 = 0 THEN {_LEAF.format(_FIELDS, _LOW, _LOW)} ELSE {_LEAF.format(_FIELDS, "text", "text")} END AS now FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
leaves AS (SELECT g, i, leaf AS d, n FROM placed),
{_levels("lower_nodes", "leaves")},
subroots AS (SELECT g AS lang_key, d FROM lower_nodes WHERE n = 1),
tops AS (SELECT 'all' AS g, row_number() OVER (ORDER BY encode(lang_key)) - 1 AS i, d, count(*) OVER () AS n, lang_key FROM subroots),
top_leaves AS (SELECT g, i, d, n FROM tops),
{_levels("upper_nodes", "top_leaves")},
nodes AS (SELECT *, 'low' AS tree FROM lower_nodes UNION ALL SELECT *, 'top' FROM upper_nodes),
high AS (SELECT g, max(l) AS h FROM lower_nodes GROUP BY g),
rungs AS (SELECT tree, g, l, i // 8 AS p, list(d ORDER BY i) AS run FROM nodes WHERE n > 1 GROUP BY tree, g, l, i // 8),
ways AS (
  SELECT p.g AS of_g, p.i AS of_i, r.l AS step, array_to_string(r.run[1:k], '') AS before, array_to_string(r.run[k + 2:], '') AS after
  FROM (SELECT g, i, l, CAST(floor(i / pow(8, l)) AS BIGINT) AS at, CAST(floor(i / pow(8, l)) AS BIGINT) % 8 AS k FROM placed, (SELECT unnest(range(30)) AS l)) p
  JOIN rungs r ON r.tree = 'low' AND r.g = p.g AND r.l = p.l AND r.p = p.at // 8
  UNION ALL
  SELECT p.g, p.i, p.h + r.l, array_to_string(r.run[1:k], ''), array_to_string(r.run[k + 2:], '')
  FROM (SELECT x.g, x.i, h, l, CAST(floor(t.i / pow(8, l)) AS BIGINT) AS at, CAST(floor(t.i / pow(8, l)) AS BIGINT) % 8 AS k FROM placed x JOIN tops t ON t.lang_key = x.g JOIN high ON high.g = x.g, (SELECT unnest(range(30)) AS l)) p
  JOIN rungs r ON r.tree = 'top' AND r.l = p.l AND r.p = p.at // 8),
proofs AS (SELECT of_g, of_i, count(*) AS steps, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM ways GROUP BY of_g, of_i),
folds AS (
  SELECT g, i, 0 AS step, now AS d FROM placed
  UNION ALL SELECT f.g, f.i, f.step + 1, sha256(w.before || f.d || w.after) FROM folds f JOIN ways w ON w.of_g = f.g AND w.of_i = f.i AND w.step = f.step)
SELECT p.doc_id, p.leaf, s.d AS subroot, r.d AS root, coalesce(proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM placed p JOIN subroots s ON s.lang_key = p.g JOIN (SELECT d FROM upper_nodes WHERE n = 1) r ON true
LEFT JOIN proofs q ON q.of_g = p.g AND q.of_i = p.i JOIN folds f ON f.g = p.g AND f.i = p.i AND f.step = coalesce(q.steps, 0)"""

"""A Merkle manifest of a table: leaves in order below each group's root, group roots below the table's, and a proof for every row."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, stored, table, with_names

#: Children of a node, and levels of an aligned block: a task holds the digests of FANOUT ** LEVELS nodes at a time.
FANOUT, LEVELS = 3, 8
_HEX = 64
_PATHS = "g string, pos long, path binary, subroot string, root string"


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value `-` if it is null, else its UTF-8 byte count, a colon and its text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def block(nodes: np.ndarray, levels: int | None, fanout: int = FANOUT) -> list[np.ndarray]:
    """The digest matrices (a row of 64 hexadecimal digits for each node) of a block, from its own nodes up: so many levels, or until one node remains.

    Whole runs are a matrix of a third of the rows and three times the width; the last run may be shorter."""
    out = [nodes]
    while (len(out) <= levels) if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        whole = len(below) // fanout
        rows = below[: whole * fanout].reshape(whole, fanout * _HEX)
        digests = [sha256(row).hexdigest() for row in rows]  # a row's bytes are those of its run, end to end
        if whole * fanout < len(below):
            digests.append(sha256(below[whole * fanout :]).hexdigest())
        out.append(np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, _HEX))
    return out


def steps(matrices: list[np.ndarray], i: int, fanout: int = FANOUT) -> list[tuple[bytes, bytes]]:
    """For node i of a block's first matrix the siblings before and after it on each level below the last."""
    out = []
    for below in matrices[:-1]:
        start = i - i % fanout
        out.append((below[start:i].tobytes(), below[i + 1 : start + fanout].tobytes()))
        i //= fanout
    return out


def _packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level how many siblings stand before and after, then those."""
    return b"".join(bytes([len(a) // _HEX, len(b) // _HEX]) + a + b for a, b in path)


def _unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    out, k = [], 0
    while k < len(data):
        a, b = data[k] * _HEX, data[k + 1] * _HEX
        out.append((data[k + 2 : k + 2 + a], data[k + 2 + a : k + 2 + a + b]))
        k += 2 + a + b
    return out


def proof(path: list[tuple[bytes, bytes]]) -> str:
    """The digest of all siblings of a path, from the leaf up, left to right."""
    return sha256(b"".join(x for pair in path for x in pair)).hexdigest()


def folded(digest: str, path: list[tuple[bytes, bytes]]) -> str:
    """The root that a digest has with these siblings."""
    now = digest.encode()
    for a, b in path:
        now = sha256(a + now + b).hexdigest().encode()
    return now.decode()


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, _HEX)


def _levels(n: int, levels: int, fanout: int) -> int | None:
    """Levels of a block in a group of n nodes: all of them where it is the group's only one, until one node remains."""
    return levels if n > fanout**levels else None


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df, written, with pos (its place in its group by order, from 0) and n (rows of the group). Groups and orders are cut into ranges together, so a large group is many tasks; rows equal in all of order are told apart by a number of their own."""
    own = df.withColumn("_tie", F.monotonically_increasing_id())
    cut = stored(own.repartitionByRange(group, *[F.asc_nulls_first(c) for c in order], "_tie").withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    counts = cut.groupBy(group, "_range").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.withColumns({"_before": F.coalesce(F.sum("_count").over(before), F.lit(0)), "n": F.sum("_count").over(Window.partitionBy(group))}).drop("_count")
    inside = Window.partitionBy("_range", group).orderBy(*[F.asc_nulls_first(c) for c in order], "_tie")
    placed = cut.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["_range", group])
    return stored(placed.withColumn("pos", (F.col("_place") + F.col("_before")).cast("bigint")).drop("_tie", "_range", "_place", "_before"), "merkle-places")


def _in_blocks(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / width).cast("bigint"))


def _climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes (g, pos, n, node), the roots of their aligned blocks, and so on until each group has one node. A pass divides a group by fanout ** levels; there is at least one."""
    width, passes = fanout**levels, [nodes.select("g", "pos", "n", "node")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows.column("n")[0].as_py()
        top = block(_matrix(rows.column("node")), _levels(n, levels, fanout), fanout)[-1]
        return pa.table({"g": rows.column("g").slice(0, 1), "pos": pa.array([rows.column("block")[0].as_py()]), "n": pa.array([-(-n // width)]), "node": pa.array([top.tobytes().decode()])})

    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(passes) == 1:
        roots = _in_blocks(passes[-1], width).groupBy("g", "block").applyInArrow(run, "g string, pos long, n long, node string")
        passes.append(stored(roots, "merkle-blocks"))
        most = -(-most // width)
    return passes


def _descend(passes: list[DataFrame], paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The paths (_PATHS) of the first pass's nodes, from those of the blocks of the last."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, (up,) = rows.sort_by("pos"), above.to_pylist()
        matrices = block(_matrix(rows.column("node")), _levels(rows.column("n")[0].as_py(), levels, fanout), fanout)
        own = [_packed(steps(matrices, i, fanout)) + up["path"] for i in range(rows.num_rows)]
        same = lambda name: pa.array([up[name]] * rows.num_rows, pa.string())
        return pa.table({"g": rows.column("g"), "pos": rows.column("pos"), "path": pa.array(own, pa.binary()), "subroot": same("subroot"), "root": same("root")})

    for nodes in reversed(passes):
        held = _in_blocks(nodes, fanout**levels).groupBy("g", "block").cogroup(paths.groupBy("g", "pos"))
        paths = stored(held.applyInArrow(run, _PATHS), "merkle-paths")
    return paths


def _proved(leaves: DataFrame, paths: DataFrame, columns: list[str], tampered: str | None, fanout: int, levels: int) -> DataFrame:
    """The rows of leaves with what the paths of their blocks and their own places in these give."""
    kinds = dict(leaves.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, (up,) = rows.sort_by("pos"), above.to_pylist()
        nodes, rest = rows.column("node").to_pylist(), _unpacked(up["path"])
        matrices = block(_matrix(rows.column("node")), _levels(rows.column("n")[0].as_py(), levels, fanout), fanout)
        shown = rows.column(tampered).to_pylist() if tampered else [None] * len(nodes)
        proofs, ends = [], []
        for i, (node, other) in enumerate(zip(nodes, shown, strict=True)):
            path = steps(matrices, i, fanout) + rest
            proofs.append(proof(path))
            ends.append(folded(node if other is None else other, path))
        same = lambda name: pa.array([up[name]] * len(nodes), pa.string())
        added = {"subroot": same("subroot"), "root": same("root"), "proof_sha256": pa.array(proofs), "folded_root": pa.array(ends), "verified": pa.array([x == up["root"] for x in ends])}
        return pa.table({c: rows.column(c) for c in columns} | added)

    return _in_blocks(leaves, fanout**levels).groupBy("g", "block").cogroup(paths.groupBy("g", "pos")).applyInArrow(run, schema)


def manifest(docs: DataFrame, leaf: str, order: list[str], group: str, tampered: str | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """docs with subroot, root, proof_sha256, folded_root and verified. leaf names the column of the rows' digests, tampered one of digests to verify instead where it isn't null.

    A group's rows ascend by order (nulls first, then the digest; rows equal in both may swap places). While a group has several nodes,
    every run of fanout becomes the digest of its hexadecimal digests; group roots, null first and then by their bytes, likewise become the
    root. Each row's path of siblings through its group and above it gives proof_sha256 and folded_root.

    Rows are numbered in ranges, and aligned blocks of fanout ** levels of them are tasks' groups, so one group may hold most rows. Block
    roots are nodes of the next pass; paths come down the same way, one a block. Any number of groups and rows; no digest comes to the
    driver, only the largest group's size. An empty table gives no rows. Columns of docs with the names of the added ones are replaced."""
    df, at = renamed(docs)
    g = F.coalesce(F.concat(F.lit("s"), F.col(at[group]).cast("string")), F.lit("n"))  # null first
    slim = stored(df.select(*at.values(), g.alias("g"), F.col(at[leaf]).alias("node")), "merkle-leaves")
    leaves = numbered(slim, "g", [*[at[c] for c in order], "node"])
    passes = _climb(leaves, fanout, levels)
    tops = numbered(passes[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), "node"), "g", ["group"])
    above = _climb(tops, fanout, levels)
    root = above[-1].select("g", "pos", F.lit(b"").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    over = _descend(above[:-1], root, fanout, levels)
    ends = tops.join(over.select("g", "pos", "path", "root"), ["g", "pos"]).select(F.col("group").alias("g"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("node").alias("subroot"), "root")
    paths = _descend(passes[1:-1], stored(ends, "merkle-paths"), fanout, levels)
    proved = _proved(leaves, paths, list(at.values()), at[tampered] if tampered else None, fanout, levels)
    return with_names(proved, at, {c: F.col(c) for c in ("subroot", "root", "proof_sha256", "folded_root", "verified")})


def op13(spark, sf_dir: str) -> DataFrame:
    """Every document a leaf of its source. Nulls are leaves' `-`; rows of a repeated or null doc_id are leaves of their own, in the order of their digests, and a null doc_id is never tampered with; very long texts are hashed whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    row = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("doc_id", "source", row(F.col("text")).alias("leaf"), F.when(hit, row(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    return manifest(leaves, "leaf", ["doc_id"], "source", "tampered").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")



def _tree_sql(name: str, leaves: str) -> str:
    """Common table expressions: name (g, lvl, pos, n, node), every level above leaves (g, pos, n, node), and name_run with the siblings before and after each node."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, n, node FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3
), {name}_run AS (
  SELECT g, lvl, pos, n, coalesce(string_agg(node, '') OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}
)"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """A recursive expression that takes start (id, g, pos, now, siblings) up a tree."""
    return f"""{name} AS (
  SELECT id, g, 0 AS lvl, pos, now, siblings, true AS more FROM {start}
  UNION ALL
  SELECT id, g, lvl + 1, f.pos // 3, sha256(before || now || after), siblings || before || after, r.n > 3 FROM {name} f JOIN {tree}_run r USING (g, lvl) WHERE r.pos = f.pos AND more AND r.n > 1
)"""


def _part_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


_ROW_SQL = " || ".join(_part_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 goes byte by byte over a table made bit by bit, for DuckDB has no such function.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT range AS b, 0 AS k, range AS c FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8), hashed AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, 'n') AS g, sha256({_ROW_SQL} || {_part_sql("text")}) AS leaf, sha256({_ROW_SQL} || {_part_sql("replace(text, chr(10), '')")}) AS other,
    list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) & 1 = 1 AS hit
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS node FROM hashed
), {_tree_sql("tree", "leaves")}, tops AS (
  SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, node FROM tree WHERE n = 1
), {_tree_sql("top", "tops")}, under AS (
  SELECT id, g, pos, CASE WHEN hit THEN other ELSE leaf END AS now, '' AS siblings FROM leaves
), {_fold_sql("inner_fold", "tree", "under")}, over AS (
  SELECT id, '' AS g, t.pos, now, siblings FROM inner_fold f JOIN tops t ON t.source = f.g JOIN (SELECT id, max(lvl) AS lvl FROM inner_fold GROUP BY id) USING (id, lvl)
), {_fold_sql("outer_fold", "top", "over")}, ended AS (SELECT * FROM outer_fold JOIN (SELECT id, max(lvl) AS lvl FROM outer_fold GROUP BY id) USING (id, lvl))
SELECT doc_id, leaf, t.node AS subroot, r.node AS root, sha256(siblings) AS proof_sha256, now AS folded_root, now = r.node AS verified
FROM leaves l JOIN tops t ON t.source = l.g JOIN ended e ON e.id = l.id CROSS JOIN (SELECT node FROM top WHERE n = 1) r"""

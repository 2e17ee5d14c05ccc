"""A manifest of a table of documents: a Merkle tree over each source's rows and one over the sources' roots.

Rows are numbered within their sources by ranges, so a source of any size is spread over all tasks. WIDTH consecutive nodes
of a tree are an aligned bucket; executors deal some buckets to a cell, where DuckDB computes LEVELS levels of all of them by
ordered string_agg and sha256. The buckets' roots are the nodes of the next round, until every tree has one node. On the way
down a bucket hands the proof of its root, one row, to the cell that has its nodes, which adds the siblings inside.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import numbered
from .crc import CRC_SQL, CRC_TABLE
from .shared import broadcast_if_few, checkpointed

#: Nodes that are hashed into one; levels of a bucket, and its nodes; nodes of a cell, about.
FAN, LEVELS = 16, 3
WIDTH, CELL = FAN**LEVELS, 4 * FAN**LEVELS
#: Of documents whose crc32 this divides, texts are tampered with.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "g long, p long, n long, d string"
PROOFS = "g long, p long, lefts array<string>, rights array<string>, subroot string, root string"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of fields, each with its length before it, null as a dash."""
    return F.sha2(F.concat(*(_field(c) for c in fields)), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """source, doc_id, d (the row's digest) and tampered (the digest of the row with its text tampered with, if it is)."""
    *others, text = (F.col(c) for c in FIELDS)
    key = F.col("doc_id").cast("long").cast("string")
    changed = F.when(F.crc32(key) % TAMPERED == 0, digest(*others, F.translate(text, UPPER, LOWER)))
    return documents.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), digest(*others, text).alias("d"), changed.alias("tampered"))


def _cell(bucket: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64("g", bucket), F.lit(cells)).alias("cell")


def _engine(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    """DuckDB over some tables, one thread, without files, with the levels of t0 (g, p, n, d) in t1 to t<LEVELS>: s is the nodes of a run, null where the tree has only one."""
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.execute("SET enable_progress_bar = false")
    for name, t in tables.items():
        con.register(name, t)
    for j in range(LEVELS):
        con.execute(f"""
            CREATE TABLE t{j + 1} AS SELECT g, p, n, s, CASE WHEN s IS NULL THEN d ELSE sha256(s) END AS d FROM (
              SELECT g, p // {FAN} AS p, (n + {FAN - 1}) // {FAN} AS n, min(d) AS d, CASE WHEN n > 1 THEN string_agg(d, '' ORDER BY p) END AS s FROM t{j} GROUP BY g, p // {FAN}, n)""")
    return con


def _roots(cell: pa.Table) -> pa.Table:
    with _engine(t0=cell.select(["g", "p", "n", "d"])) as con:
        return con.sql(f"SELECT g, p, n, d FROM t{LEVELS}").to_arrow_table()


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, p, n, d: tree, place, nodes in the tree, digest), their buckets' roots, the roots of these and so on, until every tree has one."""
    out = [nodes]
    while True:
        most, total = out[-1].agg(F.max("n"), F.count("*")).first()
        if (most or 0) <= 1:
            return out
        cell = _cell(F.floor(F.col("p") / WIDTH), total // CELL + 1)
        out.append(checkpointed(out[-1].select("g", "p", "n", "d").groupBy(cell).applyInArrow(_roots, NODES)))


#: Level j + 1 of a node: the digests of its run to the left and to the right of it, null where the tree has only one node.
_SIDES = ", ".join(f"left(t{j + 1}.s, 64 * (t0.p // {FAN**j} % {FAN})) AS a{j}, substr(t{j + 1}.s, 64 * (t0.p // {FAN**j} % {FAN}) + 65) AS b{j}" for j in range(LEVELS))
_RUNS = " ".join(f"JOIN t{j + 1} ON t{j + 1}.g = t0.g AND t{j + 1}.p = t0.p // {FAN ** (j + 1)}" for j in range(LEVELS))
_INSIDE = f"SELECT t0.*, o.lefts, o.rights, o.subroot, o.root, {_SIDES} FROM t0 {_RUNS} JOIN o ON o.g = t0.g AND o.p = t0.p // {WIDTH}"


def _proofs(nodes: pa.Table, outer: pa.Table) -> pa.Table:
    """PROOFS of nodes, from those of their buckets."""
    with _engine(t0=nodes.select(["g", "p", "n", "d"]), o=outer) as con:
        # string[] of no levels is empty, not null
        lists = [f"list_concat([x FOR x IN [{', '.join(f'{side}{j}' for j in range(LEVELS))}] IF x IS NOT NULL], {name}) AS {name}" for side, name in (("a", "lefts"), ("b", "rights"))]
        return con.sql(f"SELECT g, p, {', '.join(lists)}, subroot, root FROM ({_INSIDE})").to_arrow_table()


def _folded(rows: pa.Table, outer: pa.Table) -> pa.Table:
    """PROVED of leaves: siblings joined and hashed, and the leaf, tampered with where it is, hashed with them up to the root."""
    with _engine(t0=rows.select(["g", "p", "n", "d", "doc_id", "tampered"]), o=outer) as con:
        inner = " || ".join(f"coalesce(a{j} || b{j}, '')" for j in range(LEVELS))
        sql = f"SELECT * EXCLUDE (lefts, rights), lefts, rights, {inner} || array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), '') AS proof, coalesce(tampered, d) AS f FROM ({_INSIDE})"
        for j in range(LEVELS):
            sql = f"SELECT * EXCLUDE (f), CASE WHEN a{j} IS NULL THEN f ELSE sha256(a{j} || f || b{j}) END AS f FROM ({sql})"
        for i in range(1, (con.execute("SELECT max(len(lefts)) FROM o").fetchall()[0][0] or 0) + 1):
            sql = f"SELECT * EXCLUDE (f), CASE WHEN len(lefts) < {i} THEN f ELSE sha256(lefts[{i}] || f || rights[{i}]) END AS f FROM ({sql})"
        return con.sql(f"SELECT doc_id, d AS leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM ({sql})").to_arrow_table()


def _down(nodes: DataFrame, outer: DataFrame, work, schema: str) -> DataFrame:
    cells = nodes.count() // CELL + 1
    return nodes.groupBy(_cell(F.floor(F.col("p") / WIDTH), cells)).cogroup(outer.groupBy(_cell(F.col("p"), cells))).applyInArrow(work, schema)


def proofs(trees: list[DataFrame], outer: DataFrame) -> DataFrame:
    """PROOFS of the buckets of trees[0] (trees: of rounds()), from those of the trees' only nodes."""
    for nodes in reversed(trees[1:]):
        outer = checkpointed(_down(nodes, outer, _proofs, PROOFS))
    return outer


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of documents (doc_id, source, lang, n_chars, text).

    A leaf is the digest of these five columns; others take no part. Leaves of a source (null is a source, the first) ascend by doc_id, null first,
    equal ids by their digests; FAN consecutive nodes become one until one is left, the subroot, and subroots by source become the root.
    proof_sha256: the digest of the siblings on a leaf's way to the root. folded_root is computed from the leaf and these, verified: it
    equals the root. Texts of documents whose crc32 TAMPERED divides (null ids never) are in lower case there, so it does not where that
    changes them. Texts of any length are hashed by the JVM, equal rows are leaves each. No documents: no rows.
    """
    spark = documents.sparkSession
    # written first: a sort by ranges reads its input twice
    rows = numbered(checkpointed(leaves(documents)), [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "d", "tampered")], "number")
    rows = checkpointed(rows)
    sources = rows.groupBy("source").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    sources = checkpointed(numbered(sources, [F.col("source").asc_nulls_first()], "g"))
    named = broadcast_if_few(sources.withColumnRenamed("source", "_source"))
    nodes = checkpointed(rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("g", (F.col("number") - F.col("first")).alias("p"), "n", "d", "doc_id", "tampered"))
    trees = rounds(nodes)
    subroots = checkpointed(trees[-1].select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("p"), F.lit(sources.count()).cast("long").alias("n"), "d"))
    above = rounds(subroots)
    none = F.array().cast("array<string>")
    top = above[-1].select("g", "p", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("d").alias("root"))
    of_buckets = proofs(above, top)
    each = checkpointed(_down(subroots, of_buckets, _proofs, PROOFS))
    outer = each.drop("subroot").join(subroots.select("p", F.col("d").alias("subroot")), "p").select((F.col("p") + 1).alias("g"), F.lit(0).cast("long").alias("p"), "lefts", "rights", "subroot", "root")
    return _down(nodes, proofs(trees, checkpointed(outer)), _folded, PROVED)


def _levels_sql(name: str, levels: int) -> str:
    """CTEs <name>1 to <name><levels> over <name>0 (g, p, n, d): a level's nodes, s their run."""
    return ", ".join(
        f"{name}{j + 1} AS (SELECT g, p // 16 AS p, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN string_agg(d, '' ORDER BY p) END AS s, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d FROM {name}{j} GROUP BY g, p // 16, n)"
        for j in range(levels)
    )


def _fold_sql(rows: str, name: str, place: str, group: str, levels: int) -> str:
    """rows with f hashed up and proof grown by the siblings, level by level."""
    for j in range(levels):
        at = f"64 * (r.{place} // {16**j} % 16)"
        rows = f"(SELECT r.* EXCLUDE (f, proof), CASE WHEN x.s IS NULL THEN r.f ELSE sha256(left(x.s, {at}) || r.f || substr(x.s, {at} + 65)) END AS f, r.proof || CASE WHEN x.s IS NULL THEN '' ELSE left(x.s, {at}) || substr(x.s, {at} + 65) END AS proof FROM {rows} r JOIN {name}{j + 1} x ON x.g = r.{group} AND x.p = r.{place} // {16 ** (j + 1)})"
    return rows


def _sql(levels: int = 6, above: int = 4) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in [*FIELDS[:-1], text]) + ")"
    folded = _fold_sql("(SELECT *, coalesce(tampered, d) AS f, '' AS proof, 0 AS zero FROM leaf)", "l", "p", "g", levels)
    folded = _fold_sql(folded, "u", "g", "zero", above)
    return f"""
        WITH {CRC_TABLE}, leaf AS (
          SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d, tampered) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, doc_id, d, tampered
          FROM (SELECT source, doc_id, {leaf("text")} AS d, CASE WHEN {CRC_SQL.format("doc_id")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, crc)),
        l0 AS (SELECT g, p, n, d FROM leaf), {_levels_sql("l", levels)},
        u0 AS (SELECT 0 AS g, g AS p, (SELECT count(*) FROM l{levels}) AS n, d FROM l{levels}), {_levels_sql("u", above)}
        SELECT r.doc_id, r.d AS leaf, s.d AS subroot, t.d AS root, sha256(r.proof) AS proof_sha256, r.f AS folded_root, r.f = t.d AS verified
        FROM {folded} r JOIN l{levels} s ON s.g = r.g, u{above} t"""


SQL = _sql()

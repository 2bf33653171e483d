"""Merkle manifest of a dataset: a tree a source over its documents, a tree over the sources' roots, proofs.

Nodes are kept in external memory. Leaves are hashed, dealt out by ranges of (source, doc_id), sorted and
numbered where they lie: a node's coordinate is (part, level, place). Every FANOUT neighbours of a level
become one row of the next level's folder, with the digests it joins, and each level is made by reading
the one before it once. A part is done when one node remains.

Proofs go the other way. A row of a level meets the row above it by coordinate in a merge join, and what is
above a row is carried once for all its leaves, so that a proof costs a sixteenth of its length. A proof is
the digests to the left and to the right of the path, a pair a level.

Defined results: a null value is hashed as such, null sources are a source of their own that comes first,
null ids come first in their source; documents with the same id are ordered by their digests, and repeated
rows are leaves of their own; an empty table has no root and gives an empty result; other columns are not
part of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, table, written

FANOUT = 16
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tampered documents of the query: those whose id's CRC is divisible by this.
TAMPERED = 5


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's FIELDS; `changed` takes the place of a field."""
    values = [changed.get(f, F.col(f)).cast("string") for f in FIELDS]
    return sha(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (part, ...) with `node`, their place in their part by `order`, and `total`, the rows of the part.

    Rows are sorted in runs of about equal size, however many a part has; a run's rows are counted from its
    part's rows in the runs before it (a row a run and part).
    """
    sorted_runs = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    runs = written(sorted_runs.select("*", F.spark_partition_id().alias("_run"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), name)
    own = runs.groupBy("part", "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = W.partitionBy("part")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = own.select(F.col("part").alias("_part"), F.col("_run").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("total"))
    joined = runs.join(shift, runs["part"].eqNullSafe(shift["_part"]) & (runs["_run"] == shift["_of"]))
    return joined.withColumn("node", F.col("_at") + F.col("_shift")).drop("_part", "_of", "_run", "_at", "_shift")


@dataclass
class Tree:
    """leaves (part, node, total, digest, row) of parts, and its levels: rows (part, node, total, parts array of the digests it joins and the leaves' rows, digest)."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(part, digest)"""
        out = self.leaves.filter("total = 1").select("part", "digest")
        for level in self.levels:
            out = out.unionByName(level.filter("total = 1").select("part", "digest"))
        return out


def grow(leaves: DataFrame, name: str) -> Tree:
    """The tree of stored leaves (part, node, total, digest, row)."""
    store, levels = fresh_path(leaves.sparkSession, name), []
    below, most = leaves, leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        path = f"{store}/level={len(levels) + 1}"
        row = ["digest"] if levels else ["digest", "row"]
        groups = below.filter("total > 1").groupBy("part", F.expr(f"node div {FANOUT}").alias("above"))
        joined = groups.agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("node", *row))).alias("parts"))
        digests = F.transform("parts", lambda x: x["digest"])
        total = F.expr(f"(total + {FANOUT - 1}) div {FANOUT}").alias("total")
        up = joined.select("part", F.col("above").alias("node"), total, "parts", F.sha2(F.array_join(digests, ""), 256).alias("digest"))
        up.sortWithinPartitions("part", "node").write.parquet(path)
        below = leaves.sparkSession.read.schema(up.schema).parquet(path)
        levels.append(below)
        most = -(-most // FANOUT)
    return Tree(leaves, levels)


PATH = "array<struct<left: string, right: string>>"


def _beside(parts: Column, i: Column) -> Column:
    """What is to the left and to the right of the i-th (from 0) of parts."""
    digests = F.transform(parts, lambda x: x["digest"])
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.lit(FANOUT)), "").alias("right"))


def _by(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """b's columns beside a's rows of equal names (null is a value), by a merge join."""
    b = b.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in b.columns if c not in names])
    on = a[names[0]].eqNullSafe(b[f"_{names[0]}"])
    for n in names[1:]:
        on &= a[n] == b[f"_{n}"]
    return a.join(b.hint("merge"), on).drop(*[f"_{n}" for n in names])


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """(row, digest, path): each leaf's path of pairs up to its part's root, then the part's own path in `above` (part, path)."""
    out = _by(tree.leaves.filter("total = 1"), above, "part").select("row", "digest", "path")
    down = None
    for k, level in reversed(list(enumerate(tree.levels))):
        here = _by(level.filter("total = 1"), above, "part").select("part", "node", "parts", "path")
        if down is not None:
            here = here.unionByName(_by(level.filter("total > 1"), down, "part", "node").select("part", "node", "parts", "path"))
        each = here.select("part", "node", "path", "parts", F.posexplode("parts").alias("i", "own"))
        path = F.concat(F.array(_beside(F.col("parts"), F.col("i"))), F.col("path")).alias("path")
        if k:
            down = each.select("part", F.col("own.node").alias("node"), path)
        else:
            out = out.unionByName(each.select("own.row", "own.digest", path))
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: sha(x["left"], h, x["right"]))


@dataclass
class Manifest:
    """documents: a tree a source; sources: the tree of their roots; root: its digest, None for an empty table."""

    documents: Tree
    sources: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """(row, digest, subroot, path) of every document; row holds what `manifest` was told to keep."""
        start = self.sources.roots().select("part", F.array().cast(PATH).alias("path"))
        own = proofs(self.sources, start).select("row.part", "path", F.col("digest").alias("subroot"))
        # a part's root goes along in the last pair, so that a path's rows meet only once
        carried = own.select("part", F.concat("path", F.array(F.struct(F.col("subroot").alias("left"), F.lit("").alias("right")))).alias("path"))
        found = proofs(self.documents, carried)
        return found.select("row", "digest", F.element_at("path", -1)["left"].alias("subroot"), F.slice("path", F.lit(1), F.size("path") - 1).alias("path"))


def manifest(docs: DataFrame, **keep: Column) -> Manifest:
    """The stored manifest of docs (FIELDS); `keep` names more columns that its leaves carry beside doc_id."""
    extra = [c.alias(n) for n, c in keep.items()]
    # the number of the row tells equal rows apart, so that no range is made of one row's copies
    hashed = docs.select(F.col("source").cast("string").alias("part"), leaf_digest().alias("digest"), "doc_id", F.struct("doc_id", *extra).alias("row"), F.monotonically_increasing_id().alias("_tie"))
    places = numbered(written(hashed, "leaves"), ["doc_id", "digest", "_tie"], "runs")
    documents = grow(written(places.select("part", "node", "total", "digest", "row"), "level=0"), "documents")
    roots = documents.roots().select(F.lit(None).cast("string").alias("part"), "digest", F.col("part").alias("source"), F.struct("part").alias("row"))
    sources = grow(written(numbered(written(roots, "roots"), ["source"], "root_runs").select("part", "node", "total", "digest", "row"), "level=0"), "sources")
    top = sources.roots().first()
    return Manifest(documents, sources, top and top["digest"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    made = manifest(table(spark, sf_dir, "documents"), tampered=F.when(chosen, leaf_digest(text=lower)))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    root = F.lit(made.root).cast("string")
    out = made.proofs().select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("row.tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == root)


def _sql(levels: int = 8) -> str:
    """Every level up to 16^levels documents a source, and as many sources, written out."""
    hashed = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + "))"
    ctes = [
        "bits AS (SELECT 0 AS k, n AS i, n::BIGINT AS v FROM range(256) t(n) UNION ALL SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8)",
        "crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)",
        "chosen AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS c FROM documents d, crc)",
        f"hashed AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN c % {TAMPERED} = 0 THEN {hashed(f'''translate(text, '{ascii_uppercase}', '{ascii_lowercase}')''')} END AS bad FROM chosen)",
        "d0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY source) AS total FROM hashed)",
    ]

    def up(t: str, k: int) -> list[str]:
        return [
            f"{t}g{k} AS (SELECT source, node // {FANOUT} AS node, any_value(total) AS total, list(digest ORDER BY node) AS parts FROM {t}{k} GROUP BY source, node // {FANOUT})",
            f"{t}{k + 1} AS (SELECT source, node, (total + {FANOUT - 1}) // {FANOUT} AS total, CASE WHEN total = 1 THEN parts[1] ELSE sha256(array_to_string(parts, '')) END AS digest FROM {t}g{k})",
        ]

    for k in range(levels):
        ctes += up("d", k)
    ctes.append(f"tops AS (SELECT source AS s, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM d{levels})")
    ctes.append("s0 AS (SELECT NULL::VARCHAR AS source, place AS node, n AS total, subroot AS digest FROM tops)")
    for k in range(levels):
        ctes += up("s", k)
    ctes.append(f"p0 AS (SELECT d0.doc_id, d0.leaf, d0.source, d0.node, subroot, place, s{levels}.digest AS root, '' AS proof, coalesce(bad, leaf) AS h FROM d0 JOIN tops ON d0.source IS NOT DISTINCT FROM s, s{levels})")
    n = 0
    for t, at in (("d", "p.node"), ("s", "p.place")):
        for k in range(levels):
            i = f"(({at} // {FANOUT**k}) % {FANOUT})"
            left, right = (f"coalesce(array_to_string(g.parts[{x}], ''), '')" for x in (f"1:{i}", f"{i} + 2:{FANOUT}"))
            of = "g.source IS NOT DISTINCT FROM p.source AND " if t == "d" else ""
            ctes.append(
                f"p{n + 1} AS (SELECT p.* EXCLUDE (proof, h), CASE WHEN g.total > 1 THEN concat(proof, {left}, {right}) ELSE proof END AS proof, CASE WHEN g.total > 1 THEN sha256(concat({left}, h, {right})) ELSE h END AS h FROM p{n} p JOIN {t}g{k} g ON {of}g.node = {at} // {FANOUT ** (k + 1)})"
            )
            n += 1
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM p{n}"


OP12_SQL = _sql()

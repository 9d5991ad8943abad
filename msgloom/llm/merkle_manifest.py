"""A Merkle manifest of a dataset, with a proof of membership for every row.

A leaf is the SHA-256 of a row's fields. Leaves of a source, in order, are cut into aligned blocks of ``FAN_IN ** HEIGHT``.
A block keeps each of its levels as one string, the hex digests one behind another: parents are hashes of fixed-width
substrings, and a node's siblings are the substrings on its flanks. The blocks' roots are the nodes of the next round, until
a source has one, its subroot; the subroots, in order of source, go through the same rounds up to the dataset's root. Then
paths (the flanks at each level) are handed down, from a round to the one below, and last from blocks to their leaves.

Only digests move: texts are hashed where they are read. Ranges of (source, order) number the leaves, so a source that holds
most rows is many tasks' work. A block of 243 digests is the largest group, a round leaves 243 times fewer nodes, and the
driver sees one number a round.

Defined cases: a null field is ``-``; a null source comes first, and a null doc_id is its source's first leaf; rows with
equal doc_id are leaves of their own, by leaf digest; a lone leaf is its source's subroot, a lone subroot the root; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom.llm import sql
from msgloom.llm._io import materialize, numbered, passing

FAN_IN, HEIGHT = 3, 5
BLOCK, HEX = FAN_IN**HEIGHT, 64


def leaf(*fields: Column) -> Column:
    """The digest of one row: of each field ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _height() -> Column:
    """Levels over the leaves of a block. Only a source's first block can be its only one, and then it ends at one node."""
    alone = sum((F.when(F.size("nodes") > FAN_IN**k, 1).otherwise(0) for k in range(HEIGHT)), F.lit(0))
    return F.when(F.col("block") == 0, alone).otherwise(HEIGHT)


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (FAN_IN * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda j: F.sha2(F.substring(level, 1 + FAN_IN * HEX * j, F.lit(FAN_IN * HEX)), 256)), "")


def _levels() -> Column:
    """A block's levels, from that of its nodes up to its root."""
    lowest = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
    steps = F.filter(F.sequence(F.lit(1), F.lit(HEIGHT)), lambda k: k <= F.col("height"))
    return F.aggregate(steps, F.array(lowest), lambda found, _: F.concat(found, F.array(_parents(F.element_at(found, -1)))))


def _flanks(place: Column) -> Column:
    """The siblings left and right of the node at ``place`` of its block, then those of its ancestors within the block."""

    def at(level: Column, k: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(FAN_IN), k)).cast("int")
        start, before = 1 + FAN_IN * HEX * F.floor(own / FAN_IN).cast("int"), own % FAN_IN
        left = F.substring(level, start, HEX * before)
        right = F.substring(level, start + HEX * (before + 1), HEX * (FAN_IN - 1 - before))
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice("levels", F.lit(1), F.col("height")), at)


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """``tree, block, nodes, height`` of nodes ``tree, index, digest`` (and what they carry)."""
    rest = [c for c in nodes.columns if c not in ("tree", "index")]
    dealt = nodes.groupBy("tree", F.floor(F.col("index") / BLOCK).cast("long").alias("block"))
    found = dealt.agg(F.array_sort(F.collect_list(F.struct(F.col("index"), *rest))).alias("nodes"))
    return materialize(found.withColumn("height", _height()), name)


def _with_levels(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("levels", _levels())


def _rounds(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and the root of each tree: ``tree, digest``."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, f"{name}-blocks"))
        roots = _with_levels(rounds[-1]).select("tree", F.col("block").alias("index"), F.element_at("levels", -1).alias("digest"))
        roots = materialize(roots, f"{name}-roots")
        if not roots.agg(F.max("index")).head()[0]:
            return rounds, roots.drop("index")
        nodes = roots


def _handed_down(blocks: DataFrame, above: DataFrame, root: list[str]) -> DataFrame:
    """Nodes of ``blocks`` with their paths: their own flanks, then the path of their block in ``above``."""
    joined = _with_levels(blocks.join(above, ["tree", "block"]))
    nodes = F.transform("nodes", lambda x: F.struct(x.alias("node"), F.concat(_flanks((x["index"] % BLOCK).cast("int")), F.col("path")).alias("path")))
    return joined.select("tree", *root, F.explode(nodes).alias("x")).select("tree", *root, "x.node.*", "x.path")


def _paths(rounds: list[DataFrame], tops: DataFrame, root: list[str]) -> DataFrame:
    """The lowest round's nodes with their paths, from those of the ``tops`` (``tree, path`` and ``root``)."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in rounds[:0:-1]:
        above = _handed_down(blocks, above, root).select("tree", *root, F.col("index").alias("block"), "path")
        above = materialize(above, "manifest-paths")
    return _handed_down(rounds[0], above, root)


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (``source``, ``leaf`` and others) with ``subroot``, ``root`` and ``path``: siblings (left, right) from the leaf up."""
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    carried = [c for c in leaves.columns if c not in ("source", "leaf")]
    with passing() as keep:
        nodes = leaves.select(tree.alias("tree"), F.col("leaf").alias("digest"), *carried)
        rounds, subroots = _rounds(numbered(nodes, "tree", [*order, "digest"], "manifest-leaves"), "manifest")
        sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
        above, roots = _rounds(numbered(sources, "tree", ["source"], "manifest-sources"), "manifest-sources")
        tops = _paths(above, roots.select("tree", F.col("digest").alias("root"), nothing.alias("path")), ["root"])
        tops = materialize(tops.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "manifest-subroots")
        found = _paths(rounds, tops, ["subroot", "root"])
        source = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
        return keep(materialize(found.select(source.alias("source"), F.col("digest").alias("leaf"), *carried, "subroot", "root", "path"), "manifest"))


def proof_sha256(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(path: Column, own: Column) -> Column:
    """The root that a leaf digest and its path lead to."""
    return F.aggregate(path, own, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and what a copy without line ends in every second row's text leads to."""
    whole = ["doc_id", "source", "lang", "n_chars"]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    own = leaf(*(F.col(c) for c in whole), F.col("text"))
    other = F.when(hit, leaf(*(F.col(c) for c in whole), F.replace("text", F.lit("\n"), F.lit(""))))
    found = manifest(docs.select("source", "doc_id", own.alias("leaf"), other.alias("tampered")), ["doc_id"])
    out = found.select("doc_id", "leaf", "subroot", "root", proof_sha256(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, replace(text, chr(10), '') AS cut,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS other FROM fields),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
-- nodes of every source's tree, level by level
lower AS (
  SELECT source, 0 AS k, i, n, leaf AS h FROM numbered
  UNION ALL
  SELECT source, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lower WHERE n > 1 GROUP BY source, k, i // 3, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS n FROM lower WHERE n = 1),
upper AS (
  SELECT 0 AS k, s AS i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY k, i // 3, n),
-- every node's run of siblings: what stands before it and behind it
low_sides AS (
  SELECT a.source, a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM lower a JOIN lower b ON a.source IS NOT DISTINCT FROM b.source AND a.k = b.k AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
up_sides AS (
  SELECT a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM upper a JOIN upper b ON a.k = b.k AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT doc_id, leaf, source, 0 AS k, i, '' AS proof, CASE WHEN {crc} % 2 = 0 THEN other ELSE leaf END AS node FROM numbered
  UNION ALL
  SELECT c.doc_id, c.leaf, c.source, c.k + 1, c.i // 3, c.proof || l || r, sha256(l || c.node || r) FROM climb c JOIN low_sides s ON c.source IS NOT DISTINCT FROM s.source AND c.k = s.k AND c.i = s.i),
landed AS (
  SELECT c.doc_id, c.leaf, subroot, s, c.proof, c.node FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS nr FROM climb) c JOIN subroots u ON c.source IS NOT DISTINCT FROM u.source WHERE nr = 1),
rest AS (
  SELECT doc_id, leaf, subroot, 0 AS k, s AS i, proof, node FROM landed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.k + 1, c.i // 3, c.proof || l || r, sha256(l || c.node || r) FROM rest c JOIN up_sides s ON c.k = s.k AND c.i = s.i)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT h FROM upper WHERE n = 1) AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS nr FROM rest) WHERE nr = 1
""".replace("{crc}", sql.crc32("doc_id::VARCHAR"))

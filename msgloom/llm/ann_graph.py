"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

1. Vectors that take part are grouped by equal components; a graph is built over distinct vectors only, each with its
   smallest ``k + 1`` ids (all that a result can need), found in two salted steps so that no vector is a hot key.
2. Distinct vectors are dealt by their norm into bands (``BAND``: largest over smallest norm) and, in a band, by hash into
   shards of ``SHARD_ROWS`` at most (fewer of long vectors: ``SHARD_VALUES`` numbers). Norms are so alike in a shard that
   near directions are large inner products, whatever the norms of the table.
3. In each shard a graph of out-degree ``DEGREE`` is built over the directions: greedy searches propose neighbours, relaxed
   distance pruning keeps diverse edges, and reverse edges are added and pruned alike.
   The last points to come are first put to the graph as queries, with beams from ``BEAM`` on, doubled until ``RECALL`` of
   their exact nearest are found; that beam is kept with the shard, so it follows the dimension and the data.
4. Distinct query vectors go to the shards of their dimension and pass one loaded graph there, some hundred at a time. A
   beam search by inner product finds the nearest; their scores are inner products in double precision over the original
   components. Only each query's best of a shard leave it.
5. The shards' lists are merged, expanded to ids, and each query leaves out itself.

Directions and norms are taken after a division by the largest component, so vectors of any finite size take part; scores
are as large as doubles get, so beyond 1e308 they are infinite and tie.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as query or as
candidate; vectors of different dimensions are never compared; rows that repeat a vec_id count as one candidate for each
different vector; ties go to the smaller vec_id; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgloom.llm._io import materialize, passing

SHARD_ROWS, SHARD_VALUES, BAND, DEGREE, BEAM, ALPHA, WIDTH, BLOCK = 8192, 1 << 22, 1.25, 32, 80, 1.2, 4, 512
RECALL, ASKED, NEAREST = 0.97, 128, 20


# -- one shard -----------------------------------------------------------------------------------------------------------


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all rows of ``queries`` at once: the nearest found, their squared distances (less the query's norm), and all nodes expanded."""
    n, rows = len(points), len(queries)
    seen = np.zeros((rows, n), bool)
    ids = np.full((rows, beam), -1, np.int64)
    dist = np.full((rows, beam), np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = norms[entry] - 2 * queries @ points[entry]
    path = []
    while True:
        order = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]
        take = ~np.take_along_axis(done, order, 1)
        live = np.flatnonzero(take.any(axis=1))
        if not len(live):
            break
        r, c = np.nonzero(take)
        at = order[r, c]
        done[r, at] = True
        step = np.full((rows, WIDTH), -1, np.int64)
        step[r, c] = ids[r, at]
        path.append(step)
        near = graph[ids[r, at]]
        flat = (r[:, None] * n + near)[near >= 0]
        flat = np.unique(flat[~seen.reshape(-1)[flat]])
        if not len(flat):
            continue
        seen.reshape(-1)[flat] = True
        r, node = np.divmod(flat, n)
        d = norms[node] - 2 * np.einsum("ij,ij->i", points[node], queries[r])
        first = np.searchsorted(r, np.arange(rows))
        column = np.arange(len(r)) - first[r]
        most = int(column.max()) + 1
        new_ids, new_dist = np.full((rows, most), -1, np.int64), np.full((rows, most), np.inf, np.float32)
        new_ids[r, column], new_dist[r, column] = node, d
        ids, dist = np.concatenate([ids, new_ids], 1), np.concatenate([dist, new_dist], 1)
        done = np.concatenate([done, new_ids < 0], 1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(x, best, 1) for x in (ids, dist, done))
    return ids, dist, np.concatenate(path, 1) if path else np.zeros((rows, 0), np.int64)


def robust_prune(points: np.ndarray, norms: np.ndarray, own: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """``degree`` diverse neighbours at most of each node of ``own`` out of its row of ``candidates`` (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == own[:, None]] = -1
    vectors = points[candidates]
    d = norms[candidates] + norms[own][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, points[own])
    d[candidates < 0] = np.inf
    alive = candidates >= 0
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        if not alive.any():
            break
        pick = np.where(alive, d, np.inf).argmin(axis=1)
        some = alive[rows, pick]
        node = candidates[rows, pick]
        out[some, k] = node[some]
        between = norms[candidates] + norms[node][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, points[node])
        alive &= ~((alpha * alpha) * between <= d) & some[:, None]
        alive[rows, pick] = False
    return out


def wide_enough(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, asked: np.ndarray, entry: int, beam: int) -> int:
    """``beam``, doubled until a search finds ``RECALL`` of the nearest of the nodes ``asked`` that are not in the graph yet."""
    far = norms - 2 * points[asked] @ points.T
    far[np.arange(len(asked)), asked] = np.inf
    nearest = np.argpartition(far, NEAREST, axis=1)[:, :NEAREST]
    while beam < len(points):
        found, _, _ = beam_search(points, norms, graph, points[asked], entry, beam)
        found[found == asked[:, None]] = -1
        found = found[np.arange(len(asked))[:, None], np.argsort(np.where(found < 0, np.inf, np.take_along_axis(far, found, 1)), axis=1)[:, :NEAREST]]
        if np.mean([np.isin(a, b).mean() for a, b in zip(nearest, found)]) >= RECALL:
            break
        beam *= 2
    return beam


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512) -> tuple[np.ndarray, int, int]:
    """The graph's neighbours (-1: none) and entry point over the rows of ``vectors``, and the beam that searches need."""
    n = len(vectors)
    norm = (vectors.astype(np.float64) ** 2).sum(axis=1)
    points = np.concatenate([vectors, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)
    norms = (points.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)
    entry = int((norms - 2 * points @ points.mean(axis=0)).argmin())
    random = np.random.default_rng(7)
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        graph[:, : degree // 2] = random.integers(0, n, (n, degree // 2))
        graph[graph == np.arange(n)[:, None]] = -1
    wide, parts = beam, np.array_split(random.permutation(n), -(-n // batch))
    for turn, own in enumerate(parts):
        if 0 < turn == len(parts) - 1:
            wide = wide_enough(points, norms, graph, own[:ASKED], entry, beam)
        near, _, path = beam_search(points, norms, graph, points[own], entry, beam)
        graph[own] = robust_prune(points, norms, own, np.concatenate([near, path, graph[own]], 1), alpha, degree)
        source, target = np.repeat(own, degree), graph[own].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(nodes), int(counts.max()) if len(nodes) else 0), -1, np.int64)
        row = np.repeat(np.arange(len(nodes)), counts)
        new[row, np.arange(len(target)) - first[row]] = source
        for at in range(0, len(nodes), batch):
            part, more = nodes[at : at + batch], new[at : at + batch]
            more = more[:, : max(1, int((more >= 0).sum(axis=1).max()))]
            full = np.concatenate([graph[part], more], 1)
            room = (full >= 0).sum(axis=1) <= degree
            kept = np.sort(full, axis=1)[:, ::-1][:, :degree]
            if (~room).any():
                kept[~room] = robust_prune(points, norms, part[~room], full[~room], alpha, degree)
            graph[part] = kept
    return graph.astype(np.int32), entry, wide


# -- Spark jobs ----------------------------------------------------------------------------------------------------------


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows whose vector takes part, components in double precision."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null").filter(F.coalesce(fine, F.lit(False)))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: every different vector with its ``k`` smallest ids."""
    rows = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["v", "salt"], ["v"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("r") <= k)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the logarithms of the norms."""
    most = np.abs(vectors).max(axis=1)
    scaled = vectors / most[:, None]
    norm = np.sqrt((scaled**2).sum(axis=1))
    return scaled / norm[:, None], np.log(most) + np.log(norm)


def _log_norm(v: Column) -> Column:
    most = F.array_max(F.transform(v, F.abs))
    return F.log(most) + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / most) * (x / most))) / 2


_GRAPH = "shard long, dids binary, least binary, vectors binary, graph binary, entry long, wide long"


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("did").combine_chunks()
    vectors = _matrix(rows.column("v").chunk(0))
    graph, entry, wide = build_graph(directions(vectors)[0])
    return pa.table({
        "shard": rows.column("shard").slice(0, 1), "dids": [rows.column("did").to_numpy().astype("<i8").tobytes()], "least": [rows.column("least").to_numpy().astype("<i8").tobytes()],
        "vectors": [vectors.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()], "entry": [entry], "wide": [wide],
    })


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Shard:
    """A loaded graph that queries are put to."""

    def __init__(self, dids: bytes, least: bytes, vectors: bytes, graph: bytes, entry: int, wide: int):
        self.dids, self.least, self.entry, self.wide = np.frombuffer(dids, "<i8"), np.frombuffer(least, "<i8"), entry, wide
        self.vectors = np.frombuffer(vectors, "<f8").reshape(len(self.dids), -1)
        self.graph = np.frombuffer(graph, "<i4").reshape(len(self.dids), -1).astype(np.int64)
        unit, norm = directions(self.vectors)
        self.points = (unit * np.exp(norm - norm.max())[:, None]).astype(np.float32)

    def search(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, node and score of the ``k`` best that the beam finds."""
        found, _, _ = beam_search(self.points, np.zeros(len(self.points), np.float32), self.graph, directions(queries)[0].astype(np.float32), self.entry, max(beam, self.wide, k))
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("bcd,bd->bc", self.vectors[found], queries)
        score[found < 0] = -np.inf
        best = np.lexsort((self.least[found], -score), axis=1)[:, :k]
        row, node = np.repeat(np.arange(len(queries)), best.shape[1]), np.take_along_axis(found, best, 1).reshape(-1)
        some = np.flatnonzero(node >= 0)
        return row[some], node[some], np.take_along_axis(score, best, 1).reshape(-1)[some]


def _search(k: int, beam: int):
    names = ["qid", "did", "least", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their shard, a graph before the queries that go to it."""
        shard = None
        for batch in batches:
            qid = batch.column("qid")
            graphs = np.flatnonzero(qid.is_null().to_numpy(zero_copy_only=False))
            for start, end in zip([0, *(graphs + 1)], [*graphs, batch.num_rows]):
                for at in range(start, end, BLOCK):
                    part = batch.slice(at, min(BLOCK, end - at))
                    row, node, score = shard.search(_matrix(part.column("v")), k, beam)
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(row)), pa.array(shard.dids[node]), pa.array(shard.least[node]), pa.array(score)], names)
                if end < batch.num_rows:
                    shard = Shard(*(batch.column(c)[int(end)].as_py() for c in ("dids", "least", "vectors", "graph", "entry", "wide")))

    return search


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """The ``k`` rows of ``candidates`` with the largest inner products for each row of ``queries``, other than itself.

    Both have ``vec_id, v`` as :func:`usable` gives; returns ``query_id, rank, vec_id, score``.
    """
    with passing() as keep:
        return _nearest(candidates, queries, k, shard_rows, beam, keep)


def _nearest(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int, beam: int, keep: Callable) -> DataFrame:
    points = _distinct(candidates, k + 1).withColumn("did", F.monotonically_increasing_id())
    band = F.floor(_log_norm(F.col("v")) / float(np.log(BAND)) + 1e-6).cast("long")
    points = materialize(points.select("v", "ids", "did", F.element_at("ids", 1).alias("least"), F.size("v").alias("dim"), band.alias("band")), "ann-points")
    shards = points.groupBy("dim", "band").agg(F.count("*").alias("n"))
    shards = materialize(shards.select("dim", "band", F.ceil(F.col("n") / F.least(F.lit(shard_rows), F.greatest(F.lit(64), F.floor(SHARD_VALUES / F.col("dim"))))).alias("parts")), "ann-bands")
    of = lambda part: F.xxhash64("dim", "band", part)
    dealt = points.join(shards, ["dim", "band"]).select(of(F.pmod(F.xxhash64("did"), F.col("parts"))).alias("shard"), "did", "least", "v")
    graphs = materialize(dealt.groupBy("shard").applyInArrow(_build, _GRAPH), "ann-graphs")
    asked = materialize(queries.distinct().groupBy("v").agg(F.count("*").alias("n")).withColumn("did", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "ann-queries")
    places = shards.select("dim", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("dim", of(F.col("part")).alias("shard"))
    rows = asked.select("dim", F.col("did").alias("qid"), "v").join(places, "dim").select("shard", "qid", "v")
    rows = rows.unionByName(graphs, allowMissingColumns=True).repartition("shard").sortWithinPartitions(F.col("shard"), F.col("qid").asc_nulls_first())
    found = materialize(rows.mapInArrow(_search(k + 1, beam), "qid long, did long, least long, score double"), "ann-found")
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "least")
    found = found.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k + 1).join(points.select("did", "ids"), "did")
    by_id = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("list"))  # k + 1 at most
    lists = asked.select("v", F.col("did").alias("qid")).join(lists, "qid").drop("qid")
    own = queries.distinct().select(F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    kept = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(kept).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    return keep(materialize(out, "ann-nearest"))

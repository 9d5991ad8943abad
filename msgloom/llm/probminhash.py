"""Near duplicates by ProbMinHash over weighted five-word shingles.

1. Every different shingle of a text, weighted by its number of occurrences, starts a Poisson process of that rate whose
   arrivals fall on random registers; a register keeps the shingle that arrives first. Two texts agree in a register
   with the probability Jaccard similarity of their weighted shingles. Arrivals are generated only up to a time by which
   all registers are expected to be filled (early termination), and further where some are not.
2. Registers are banded (``BANDS`` of ``ROWS``): at a similarity of 0.8 a pair shares no band with probability 3e-6. A text
   that repeats shingles gets a second signature with weights of 1, so that the same holds of plain Jaccard similarity.
3. Inside a bucket no pairs are listed: every member is compared with the bucket's leader, and links are verified on the
   exact shingles. Where a bucket still holds more than one class, those outside its largest class are the query set:
   in blocks, they are compared with all members of other classes by exact set overlaps (a product of 0/1 matrices per
   block), which gives out one link for each of them and class. So no link between different texts that share a bucket
   is lost, and a group of near copies costs its size, not its square, unless its members are really apart.
4. Classes are the connected components of the links, found by alternating large-star and small-star steps.

A pair is linked at ``threshold`` or more of the probability Jaccard similarity, or of the plain one (they differ only
where shingles repeat). Equal texts are one node from the start, joined by a digest (map-side combined).

Defined cases: a null or empty text, or one without a word, is in a class of its own unless the same non-empty text
repeats; a text of fewer than five words has one shingle, all its words; a null doc_id takes part, and ``class_id`` is
the smallest non-null doc_id of the class; ties for the kept row go to the smallest (doc_id, row); columns of any name
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgloom.llm._io import buffer_of, holds, lean, materialize, only_keys_of, passing, pieces_of, placed
from msgloom.llm.words import mix, shingles, weighted, word_hashes

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
LEADERS, OUT_BLOCK, IN_BLOCK, COLUMNS = 4, 256, 1024, 4096
BATCH_BYTES = 1 << 20
_STEP, _SPOT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# -- signatures ----------------------------------------------------------------------------------------------------------


def probminhash(items: np.ndarray, weights: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """The registers of each text from its different items: the item that arrives first in each (0: no items)."""
    n = len(counts)
    out = np.zeros((n, registers), np.uint64)
    doc = np.repeat(np.arange(n), counts)
    total = np.bincount(doc, weights, n)
    limit = np.where(total > 0, registers * (np.log(registers) + 3) / np.maximum(total, 1), 0.0)
    todo = counts > 0
    while todo.any():
        own = np.flatnonzero(todo[doc])
        d, s, w = doc[own], items[own], weights[own].astype(np.float64)
        time, seed = np.zeros(len(own)), s.copy()
        first = np.full(n * registers, np.inf)
        points = []
        while len(own):
            seed = mix(seed + _STEP)
            time = time - np.log((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / w
            live = time <= limit[d]
            d, s, w, time, seed = d[live], s[live], w[live], time[live], seed[live]
            own = own[live]
            at = d * registers + (mix(seed ^ _SPOT) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, at, time)
            points.append((at, time, s))
        at, time, s = (np.concatenate(x) for x in zip(*points))
        won = time == first[at]
        out.reshape(-1)[at[won]] = s[won]
        unfilled = np.isinf(first.reshape(n, registers)).any(axis=1)
        todo &= unfilled
        limit[todo] *= 2
    return out


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of each row of registers."""
    h = np.zeros((len(registers), bands), np.uint64)
    for j in range(rows):
        h = mix(h + registers[:, j::rows][:, :bands] + np.arange(1, bands + 1, dtype=np.uint64))
    return h.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard and plain Jaccard similarities of (sorted items, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    if a[1].max() == 1 and b[1].max() == 1:
        return plain
    v, w = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    ratio = v / w
    order = np.argsort(ratio, kind="stable")
    only_a, only_b = a[1].sum() - v.sum(), b[1].sum() - w.sum()
    from_here = np.concatenate([np.cumsum(v[order][::-1])[::-1], [0]]) + only_a
    up_to_here = np.concatenate([[0], np.cumsum(w[order])]) + only_b
    at = np.searchsorted(ratio[order], ratio, "left")
    return max(plain, float((1 / (from_here[at] / v + up_to_here[at] / w)).sum()))


def signatures(items: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' band keys in order, and how many each text has.

    A text that repeats shingles is signed twice, by its weights and with weights of 1, so that it shares bands with those
    that it resembles in either way; of the second signature only what differs from the first is given.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    own = np.flatnonzero(counts > 0)
    keys = band_keys(probminhash(items, weights, counts, BANDS * ROWS))[own]
    row, keys = np.repeat(own, BANDS), keys.reshape(-1)
    twice = np.unique(doc[weights > 1])
    if len(twice):
        some = np.isin(doc, twice)
        plain = band_keys(probminhash(items[some], np.ones(int(some.sum())), counts[twice], BANDS * ROWS)).reshape(-1)
        other = plain != keys[np.isin(row, twice)]
        row, keys = np.concatenate([row, np.repeat(twice, BANDS)[other]]), np.concatenate([keys, plain[other]])
        keys = keys[np.argsort(row, kind="stable")]
    return keys, np.bincount(row, minlength=len(counts))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        for start, end in pieces_of(batch, "text", BATCH_BYTES):
            keys, sizes = signatures(*weighted(*shingles(*word_hashes(data, offsets[start : end + 1]), SHINGLE)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys))
            names = ["file", "at", "id", "digest"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, end - start) for c in names), lists], [*names, "bands"])


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for start, end in pieces_of(batch, "text_a", 4 * BATCH_BYTES):
                sets: dict[int, tuple] = {}
                for ids, name in ((a, "text_a"), (b, "text_b")):
                    own, first = np.unique(ids[start:end], return_index=True)
                    rows = batch.column(name).take(pa.array(start + first))
                    data, offsets = buffer_of(rows)
                    at = 0
                    while at < len(own):
                        to = min(len(own), max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1))
                        items, weights, sizes = weighted(*shingles(*word_hashes(data, offsets[at : to + 1]), SHINGLE))
                        ends = np.cumsum(sizes)
                        for k, (x, y) in enumerate(zip(ends - sizes, ends)):
                            sets[int(own[at + k])] = items[x:y], weights[x:y]
                        at = to
                near = np.asarray([similarity(sets[x], sets[y]) for x, y in zip(a[start:end].tolist(), b[start:end].tolist())]) >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(a[start:end][near]), pa.array(b[start:end][near])], ["a", "b"])

    return verify


# -- components ----------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``node, comp`` of every node of ``edges`` (``a, b``): comp is the smallest node that it is linked with."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()
        edges = materialize(small, name)
        now = mark(edges)
        if now == before:
            break
        before = now
    up = edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
    roots = edges.select("b").distinct().join(up.select(F.col("node").alias("b")), "b", "left_anti")
    return up.unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("comp")))


# -- the operator --------------------------------------------------------------------------------------------------------


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b: different nodes) that the exact shingles confirm."""
    a, b = texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b"))
    return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(lean(_verify(threshold)), "a long, b long"), "near-links")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column("_text"))
        for start, end in pieces_of(batch, "_text", BATCH_BYTES):
            items, weights, sizes = weighted(*shingles(*word_hashes(data, offsets[start : end + 1]), SHINGLE))
            ends = np.cumsum(sizes)
            spans = list(zip((ends - sizes).tolist(), ends.tolist()))
            own = pa.array([items[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary())
            many = pa.array([weights[a:b].astype("<u4").tobytes() if (weights[a:b] > 1).any() else b"" for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(start, end - start), own, many], ["node", "items", "weights"])


def _compare_blocks(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of a block of outsiders (``out``) with a block of members: the first for each outsider and class."""
        items = [np.frombuffer(x, "<u8") for x in rows["items"]]
        weights = [np.frombuffer(w, "<u4") if len(w) else np.ones(len(x), np.uint32) for w, x in zip(rows["weights"], items)]
        node, comp, out = rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["out"].to_numpy(bool)
        a, b = np.flatnonzero(out), np.flatnonzero(~out)
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return none
        sizes = np.asarray([len(x) for x in items])
        values, column, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(items)), sizes)
        often = times > 1  # others overlap with nothing
        column, owner = (np.cumsum(often) - 1)[column[often[column]]], owner[often[column]]
        common = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, int(often.sum()), COLUMNS):
            some = (column >= start) & (column < start + COLUMNS)
            m = np.zeros((len(items), COLUMNS), np.float32)
            m[owner[some], column[some] - start] = 1
            common += m[a] @ m[b].T
        near = common / (sizes[a][:, None] + sizes[b][None, :] - common)
        other = comp[a][:, None] != comp[b][None, :]
        hit = other & (near >= threshold - 1e-6)
        repeats = np.asarray([len(w) > 0 for w in rows["weights"]])
        weighed = other & ~hit & (repeats[a][:, None] | repeats[b][None, :]) & (common > 0)
        for i, j in zip(*np.nonzero(weighed)):
            hit[i, j] = similarity((items[a[i]], weights[a[i]]), (items[b[j]], weights[b[j]])) >= threshold - 1e-12
        i, j = np.nonzero(hit)
        if not len(i):
            return none
        found = pd.DataFrame({"a": node[a[i]], "b": node[b[j]], "c": comp[b[j]]})
        return found.drop_duplicates(["a", "c"])[["a", "b"]]

    return compare


def _outside_links(shared: DataFrame, comps: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links across classes inside buckets: members outside a bucket's largest class against all other members."""
    named = shared.select("band", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = named.groupBy("band", "comp").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("band").agg(F.count("*").alias("classes"), F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top")).filter("classes > 1")
    mixed = mixed.select("band", F.col("top.comp").alias("top"), F.ceil(F.col("n") / IN_BLOCK).cast("int").alias("ins"), F.ceil((F.col("n") - F.col("top.c")) / OUT_BLOCK).cast("int").alias("outs"))
    rows = materialize(named.join(mixed, "band"), "near-mixed")
    items = texts.join(rows.select("node").distinct(), "node", "left_semi").mapInArrow(lean(_items), "node long, items binary, weights binary")
    spread = F.xxhash64("node")
    out = rows.filter("comp <> top").select("band", "node", "comp", F.lit(True).alias("out"), F.pmod(spread, F.col("outs")).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("ins") - 1)).alias("i"))
    own = rows.select("band", "node", "comp", F.lit(False).alias("out"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("o"), F.pmod(spread, F.col("ins")).cast("int").alias("i"))
    work = out.unionByName(own).join(materialize(items, "near-items"), "node")
    return materialize(work.groupBy("band", "o", "i").applyInPandas(_compare_blocks(threshold), "a long, b long"), "near-more")


def _assigned(base: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """``file, at, id, class_id, class_size, kept`` of each row of a :func:`placed` table."""
    with passing() as keep:
        named = keep(_classes(base, id_col, threshold))
    per = named.groupBy("comp").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"))
    return named.join(per, "comp").select("file", "at", "id", "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"))


def _classes(base: DataFrame, id_col: str, threshold: float) -> DataFrame:
    whole = F.col("whole")
    text, id_ = whole.getField("text").cast("string"), whole.getField(id_col)
    lower = F.lower(F.coalesce(text, F.lit("")))
    digest = F.when(F.length(text) > 0, F.sha2(text.cast("binary"), 256)).otherwise(F.concat_ws(" ", F.lit("row"), "at", "file"))
    read = base.select("file", "at", id_.alias("id"), digest.alias("digest"), lower.alias("text"))
    kinds = [T.StructField("digest", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    signed = read.mapInArrow(lean(_sign), T.StructType([*(read.schema[c] for c in ("file", "at", "id")), *kinds]))
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    nodes = materialize(signed.groupBy("digest").agg(F.min("row").alias("node"), F.any_value("bands").alias("bands")), "near-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    turn = F.xxhash64("node", F.pmod("band", F.lit(LEADERS)))
    leaders = buckets.groupBy("band").agg(F.min_by("node", turn).alias("b"), F.count("*").alias("size")).filter("size > 1")
    leaders = materialize(leaders, "near-leaders")  # apart from the join, so that a hot bucket can be split
    shared = materialize(buckets.join(leaders, "band"), "near-buckets")  # only buckets of two nodes or more
    known = materialize(shared.select("node").distinct(), "near-known")
    places = only_keys_of(signed.select(F.col("row").alias("node"), "file", "at"), "node", known).join(known, "node", "left_semi")
    places = materialize(places, "near-places")
    inside = holds(places.select("file", "at"))
    texts = base.filter(inside("file", "at")).select("file", "at", lower.alias("_text")).join(places, ["file", "at"])
    texts = materialize(texts.select("node", "_text"), "near-texts")
    pairs = shared.filter("node <> b").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    links = _links(pairs, texts, threshold)
    comps = components(links)
    more = _outside_links(shared.filter("size > 2"), comps, texts, threshold)
    if more.take(1):
        comps = components(links.unionByName(more))
    of = nodes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    return materialize(signed.select("row", "file", "at", "id", "digest").join(of, "digest").select("row", "file", "at", "id", "comp"), "near-classes")


def one_of_each(df: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, that are kept: one of each class."""
    base = placed(df)
    gone = materialize(_assigned(base, id_col, threshold).filter("not kept").select("file", "at"), "near-gone")
    suspect = holds(gone)  # rows outside the bitmap stay where they are
    left = base.filter(suspect("file", "at")).join(gone, ["file", "at"], "left_anti")
    return base.filter(~suspect("file", "at")).unionByName(left).select("whole.*")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, class_id, class_size, kept``: one row per row of ``df``."""
    final = _assigned(placed(df, id_col, "text"), id_col, threshold)
    return final.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")

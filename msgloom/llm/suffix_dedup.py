"""Repeated substrings across a corpus, by suffix arrays over the places where they can lie.

Two kinds of strings are looked for, either or both in one run: all strings of ``min_bytes`` bytes, and all runs of
``min_words`` words (from a word's start to a word's end, :func:`msgloom.llm.words.word_windows`) of whatever length. Every
byte covered by a string that also starts anywhere else (in any text, the same one included) is found, as judged on the
input.

1. One narrow pass gives every string to an anchor: the gram in it with the smallest hash (the leftmost of equal ones).
   Equal strings have equal anchors at equal places, so they need only be compared under their gram. The strings of one
   anchor start side by side; the bytes that they cover are its segment.
2. Grams are counted with map-side combination. Anchors that stand alone end here. Equal segments under a gram are one
   kind; a single representative of each goes on, with the number of its members.
3. A gram is dealt to a shard by the first document that holds it and the place there. Neighbouring anchors of a family
   of similar texts so meet in one shard, and their overlapping segments are cut from a text once, as one region.
4. Each shard builds a suffix array of its regions by induced sorting and its permuted common prefixes
   (:mod:`msgloom.llm.suffix_array`). A run of prefixes that are long enough is a repeat if it holds two places, or one
   of a kind with several members. Nothing is removed but by this step.
5. A gram with more than ``HOT`` kinds (a very common passage) would outgrow a shard. Its strings are dealt again under
   longer grams: in ``RANGES`` ranges of places (four of words) by all that the strings of a range share, and where that is
   still too common, each string by itself, which leaves one kind a gram. The shards then decide about those.
6. What a shard finds for a kind is carried to its members, merged per document and cut out. Documents outside a
   fixed-size bitmap of suspects never move.

Grams, kinds and strings are told apart by 64-bit hashes in pairs of two (gram and segment); the repeats themselves are
compared byte by byte.

Defined cases: a null text is empty; texts shorter than ``min_bytes`` keep everything; repeated rows are different
places, so their long strings all go; a null id is an id of its own; further columns are ignored or, in
:func:`without_repeats`, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, forget, lean, materialize, passing, pieces_of
from msgloom.llm.pieces import Spans
from msgloom.llm.suffix_array import permuted_lcp, suffix_array
from msgloom.llm.words import mix, word_windows

MIN_BYTES, MIN_WORDS, MOST_GRAM, SHARD_BYTES, FEW, HOT, RANGES, BITMAP_BITS = 400, 51, 64, 1 << 19, 32, 512, 8, 26
BATCH_BYTES = 1 << 19  # texts that a worker hashes at once: some 100 bytes of arrays a byte


@dataclass(frozen=True)
class Wanted:
    """Which strings are looked for: of so many bytes, of so many words, or both."""

    min_bytes: int | None = MIN_BYTES
    min_words: int | None = None

    @property
    def least(self) -> int:
        """Bytes that the shortest string can take."""
        return min(x for x in (self.min_bytes, self.min_words and 2 * self.min_words - 1) if x)


# -- anchors -------------------------------------------------------------------------------------------------------------


def gram_bytes(min_bytes: int) -> int:
    return min(MOST_GRAM, min_bytes // 2)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``x[i:i+width]`` at every ``i`` (of fewer at the end)."""
    out, step = x.copy(), 1
    while step * 2 <= width:
        np.minimum(out[:-step], out[step:], out=out[:-step])
        step *= 2
    rest = width - step
    if rest:
        out[:-rest] = np.minimum(out[:-rest], out[rest:])
    return out


def least_between(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest of ``x[start:end]`` for every pair (none empty)."""
    out = np.empty(len(starts), x.dtype)
    level = np.frexp(ends - starts)[1] - 1
    step = x.copy()
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(step[starts[own]], step[ends[own] - (1 << k)])
        np.minimum(step[: -(1 << k)], step[1 << k :], out=step[: -(1 << k)])
    return out


def anchors(data: np.ndarray, sizes: np.ndarray, min_bytes: int, min_words: int | None = None, gram: int | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: text number, gram hash, segment hash, and start, place and end in the text.

    Of the strings of ``min_bytes`` bytes; with ``min_words``, of the runs of so many words.
    """
    found = list(_anchors(data, sizes, Wanted(None if min_words else min_bytes, min_words), gram or gram_bytes(2 * min_words - 1 if min_words else min_bytes)))
    return tuple(found[0][1:]) if found else (np.zeros(0, np.int64),) * 6


def _anchors(data: np.ndarray, sizes: np.ndarray, what: Wanted, gram: int) -> Iterator[tuple]:
    """For bytes (0), then for words (1): that number and :func:`anchors`."""
    n = len(data)
    if n < what.least or not (sizes >= what.least).any():
        return
    ends = np.cumsum(sizes)
    spans = Spans(data)
    at = np.arange(n - gram + 1)
    h = spans.hashes(at, at + gram)
    keys = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(h)] = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    for words in (0, 1):
        if words and what.min_words:
            starts, stops = word_windows(data, sizes, what.min_words)
            least = least_between(keys, starts, stops - gram + 1)
        elif not words and what.min_bytes:
            starts = np.flatnonzero(np.repeat(ends, sizes) - np.arange(n) >= what.min_bytes)  # of whole strings
            stops = starts + what.min_bytes
            least = _sliding_least(keys, what.min_bytes - gram + 1)[starts]
        else:
            continue
        if not len(starts):
            continue
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        if not words:
            new[1:] |= starts[1:] != starts[:-1] + 1
        first = starts[new]
        last = stops[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
        place = anchor[new]
        doc = np.searchsorted(ends, place, "right")
        begin = ends[doc] - sizes[doc]
        segment = mix(spans.hashes(first, last) + (place - first).astype(np.uint64))
        g = (h[place] & ~np.uint64(1)) | np.uint64(words)
        yield words, doc, g.astype(np.int64), segment.astype(np.int64), first - begin, place - begin, last - begin


def _anchor_rows(what: Wanted):
    gram, names = gram_bytes(what.least), ["id", "key", "g", "s", "first", "at", "last"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for start, end in pieces_of(batch, "text", BATCH_BYTES):
                for _, doc, g, s, first, at, last in _anchors(data[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1]), what, gram):
                    rows = pa.array(start + doc)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), pa.array(g), pa.array(s), *(pa.array(x.astype(np.int32)) for x in (first, at, last))], names)

    return find


# -- one shard -----------------------------------------------------------------------------------------------------------


def repeated_in(regions: list[bytes], owner: np.ndarray, first: np.ndarray, last: np.ndarray, members: np.ndarray, words: np.ndarray, what: Wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings of the kinds that lie in ``regions``: number of the kind, and start and end counted from its first byte.

    A kind is the strings between ``first`` and ``last`` of region ``owner`` (of words or of bytes), and has so many members.
    """
    sizes = np.asarray([len(x) for x in regions], np.int64)
    joined = np.frombuffer(b"\0".join(regions), np.uint8).astype(np.int32) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    joined[(begin + sizes)[:-1]] = 0  # a separator smaller than every byte
    sa = suffix_array(joined, 257)
    same = permuted_lcp(joined, sa)
    found = []
    pos, end = begin[owner] + first, begin[owner] + last
    own = np.flatnonzero(~words)
    if len(own):
        a, b = _repeated_bytes(sa, same, pos[own], end[own] - what.min_bytes + 1, members[own], np.repeat(begin + sizes, sizes + 1)[: len(joined)], what.min_bytes)
        found.append((own[a], *b))
    own = np.flatnonzero(words)
    if len(own):
        a, b = _repeated_words(regions, sizes, sa, same, pos[own], end[own], members[own], what.min_words)
        found.append((own[a], *b))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _repeated_bytes(sa: np.ndarray, same: np.ndarray, pos: np.ndarray, stop: np.ndarray, members: np.ndarray, end: np.ndarray, min_bytes: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of kinds whose strings start in ``pos:stop`` (no two alike)."""
    n = len(sa)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, pos, members - 1)
    np.add.at(step, stop, 1 - members)
    weight = 1 + np.cumsum(step[:-1])
    long_enough = same[sa] >= min_bytes
    long_enough[0] = False
    start = np.flatnonzero(~long_enough)
    several = np.add.reduceat(weight[sa], start) > 1
    repeats = np.zeros(n + 1, bool)
    repeats[sa] = np.repeat(several, np.diff(np.append(start, n)))
    repeats[:-1] &= end - np.arange(n) >= min_bytes
    edge = np.flatnonzero(repeats[1:] != repeats[:-1]) + 1
    edge = np.concatenate([[0], edge]) if repeats[0] else edge
    low, high = edge[::2], edge[1::2]  # runs of repeated starts
    i, j = np.searchsorted(high, pos, "right"), np.searchsorted(low, stop, "left")  # runs i to j - 1 meet the kind
    count = np.maximum(j - i, 0)
    kind = np.repeat(np.arange(len(pos)), count)
    run = np.repeat(i - (np.cumsum(count) - count), count) + np.arange(len(kind))
    a, b = np.maximum(low[run], pos[kind]), np.minimum(high[run], stop[kind])
    return kind, (a - pos[kind], b - 1 + min_bytes - pos[kind])


def _repeated_words(regions: list[bytes], sizes: np.ndarray, sa: np.ndarray, same: np.ndarray, pos: np.ndarray, end: np.ndarray, members: np.ndarray, min_words: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The same for runs of words: equal ones have equal lengths and a common prefix of that length."""
    none = np.zeros(0, np.int64)
    starts, stops = word_windows(np.frombuffer(b"".join(regions), np.uint8), sizes, min_words)
    region = np.searchsorted(np.cumsum(sizes), starts, "right")
    at, need = starts + region, stops - starts  # a separator stands before each further region
    by = np.argsort(pos, kind="stable")
    kind = np.searchsorted(pos[by], at, "right") - 1
    inside = np.flatnonzero((kind >= 0) & (at + need <= end[by[np.maximum(kind, 0)]]))  # a region's edges may cut a word of other strings
    kind, at, need = by[kind[inside]], at[inside], need[inside]
    if not len(at):
        return none, (none, none)
    rank = np.empty(len(sa), np.int64)
    rank[sa] = np.arange(len(sa))
    order = np.lexsort((rank[at], need))
    r, n = rank[at[order]], need[order]
    new = np.ones(len(order), bool)
    pair = np.flatnonzero(n[1:] == n[:-1])
    new[pair + 1] = least_between(same[sa], r[pair] + 1, r[pair + 1] + 1) < n[pair]
    several = np.add.reduceat(members[kind[order]], np.flatnonzero(new)) > 1
    hit = np.sort(order[several[np.cumsum(new) - 1]])
    if not len(hit):
        return none, (none, none)
    kind, a, b = kind[hit], at[hit], (at + need)[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (a[1:] > b[:-1])
    begin, close = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hit)) - 1
    kind = kind[begin]
    return kind, (a[begin] - pos[kind], b[close] - pos[kind])


_KIND = np.dtype([(x, "<i8") for x in ("g", "s", "n", "first", "last")])
_FOUND = "id long, key long, g long, s long, n long, first long, a long, b long"


def _shard(what: Wanted):
    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        kinds = [np.frombuffer(x, _KIND) for x in rows.column("kinds").to_pylist()]
        owner = np.repeat(np.arange(len(kinds)), [len(x) for x in kinds])
        flat = np.concatenate(kinds)
        begin = rows.column("begin").to_numpy()[owner]
        kind, a, b = repeated_in(rows.column("bytes").to_pylist(), owner, flat["first"] - begin, flat["last"] - begin, flat["n"], (flat["g"] & 1) == 1, what)
        own, at = flat[kind], pa.array(owner[kind])
        arrays = [rows.column("id").take(at), rows.column("key").take(at), *(pa.array(own[x]) for x in ("g", "s", "n", "first")), pa.array(a), pa.array(b)]
        return pa.table(arrays, names=["id", "key", "g", "s", "n", "first", "a", "b"])

    return shard


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's wanted segments, those that overlap in a shard as one region with the kinds in it."""
    names = ["id", "key", "shard", "begin", "bytes", "kinds"]
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        wanted = batch.column("wanted")
        flat = wanted.flatten()
        col = {x: flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("shard", "g", "s", "n", "first", "last")}
        doc = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        order = np.lexsort((col["first"], col["shard"], doc))
        doc, col = doc[order], {k: v[order] for k, v in col.items()}
        group = np.ones(len(doc), bool)
        group[1:] = (doc[1:] != doc[:-1]) | (col["shard"][1:] != col["shard"][:-1])
        far = np.maximum.accumulate(col["last"] + (np.cumsum(group) << 32))  # the last byte so far in each group
        new = group.copy()
        new[1:] |= col["first"][1:] + (np.cumsum(group)[1:] << 32) >= far[:-1]
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        close = np.append(begin[1:], len(doc))
        high = (far[close - 1] & 0xFFFFFFFF).tolist()
        kinds = np.empty(len(doc), _KIND)
        for x in _KIND.names:
            kinds[x] = col[x]
        low, own = col["first"][begin].tolist(), doc[begin]
        for start in range(0, len(begin), 1000):
            part = range(start, min(start + 1000, len(begin)))
            cuts = [data[offsets[own[k]] + low[k] : offsets[own[k]] + high[k]].tobytes() for k in part]
            lists = [kinds[begin[k] : close[k]].tobytes() for k in part]
            rows = pa.array(own[start : start + 1000])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), pa.array(col["shard"][begin[start : start + 1000]]), pa.array(low[start : start + 1000], pa.int64()), pa.array(cuts, pa.binary()), pa.array(lists, pa.binary())], names)


# -- very common grams ---------------------------------------------------------------------------------------------------


def _finer(what: Wanted, level: int):
    """Strings of very common grams under longer grams: level 1 by ranges of places, level 2 each by itself."""
    gram, names = gram_bytes(what.least), ["id", "key", "up_g", "up_s", "up_first", "g", "s", "n", "first", "at", "last"]
    edges = np.linspace(gram - (what.min_bytes or gram), 1, RANGES + 1).astype(np.int64)  # starts of ranges, from the anchor
    step = -(-(what.min_words or 1) // 4)  # words of a range

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(start, end - start) for whole in batches for start, end in pieces_of(whole, "text", BATCH_BYTES)):
            data, offsets = buffer_of(batch.column("text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            col = {x: flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("g", "s", "n", "first", "at", "last")}
            doc = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            spans, at0 = Spans(data), offsets[doc]

            def rows(k: np.ndarray, first: np.ndarray, last: np.ndarray, core: np.ndarray) -> pa.RecordBatch:
                own = pa.array(doc[k])
                g = (mix(core) & ~np.uint64(1)) | (col["g"][k] & 1).astype(np.uint64)
                s = mix(spans.hashes(at0[k] + first, at0[k] + last) + (col["at"][k] - first).astype(np.uint64))
                up = [pa.array(col[x][k]) for x in ("g", "s", "first")]
                return pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("key").take(own), *up, pa.array(g.astype(np.int64)), pa.array(s.astype(np.int64)), pa.array(col["n"][k]), *(pa.array(x.astype(np.int32)) for x in (first, col["at"][k], last))], names)

            words = (col["g"] & 1) == 1
            for k in np.flatnonzero(words):
                part = data[at0[k] + col["first"][k] : at0[k] + col["last"][k]]
                a, b = (x + col["first"][k] for x in word_windows(part, np.asarray([len(part)]), 1))
                low, high = np.arange(len(a) - what.min_words + 1), np.arange(what.min_words - 1, len(a))  # first and last word of each run
                core = low, high
                if level == 1:
                    here = np.searchsorted(a, col["at"][k], "right") - 1
                    r = (here - low) // step  # words in front of the anchor
                    begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    core = here - r[begin] * step, here - (r[begin] + 1) * step + what.min_words  # words in all runs of the range
                    low, high = low[begin], high[np.append(begin[1:], len(r)) - 1]
                same = spans.hashes(at0[k] + a[core[0]], at0[k] + b[core[1]]) + (r[begin].astype(np.uint64) if level == 1 else np.uint64(RANGES))
                yield rows(np.full(len(low), k), a[low], b[high], same)
            plain = np.flatnonzero(~words)
            if level == 1:
                for r in range(RANGES) if len(plain) else ():
                    lo, hi = col["at"][plain] + edges[r], col["at"][plain] + edges[r + 1] - 1  # first and last start
                    a, b = np.maximum(lo, col["first"][plain]), np.minimum(hi, col["last"][plain] - what.min_bytes)
                    some = np.flatnonzero(a <= b)
                    k = plain[some]
                    core = spans.hashes(at0[k] + hi[some], at0[k] + lo[some] + what.min_bytes)  # in all of the range's strings
                    yield rows(k, a[some], b[some] + what.min_bytes, core + np.uint64(r))
            else:
                for k in np.array_split(plain, len(plain) // 500 + 1) if len(plain) else ():
                    count = col["last"][k] - col["first"][k] - what.min_bytes + 1
                    a = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(col["first"][k], count)
                    k = np.repeat(k, count)
                    yield rows(k, a, a + what.min_bytes, spans.hashes(at0[k] + a, at0[k] + a + what.min_bytes) + np.uint64(RANGES))

    return find


# -- Spark jobs ----------------------------------------------------------------------------------------------------------


def _keyed(df: DataFrame, id_col: str) -> DataFrame:
    """The columns of ``df``, under any names, as ``__whole``, with ``__id``, ``__text`` and ``__key``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.struct("*").alias("__whole"), F.col(id_col).cast("long").alias("__id"), text.alias("__text")).withColumn("__key", F.xxhash64("__id", "__text"))


def _kinds(segments: DataFrame, members: Column) -> DataFrame:
    """One row for each kind of ``segments``: its members, and its first row as the representative."""
    rows = segments.withColumn("row", F.monotonically_increasing_id())
    return materialize(rows.groupBy("g", "s").agg(members.alias("n"), F.min("row").alias("row"), *(F.min_by(x, "row").alias(x) for x in ("id", "key", "first", "at", "last"))), "repeat-kinds")


def _of_documents(docs: DataFrame, kinds: DataFrame, *columns: str) -> DataFrame:
    """``id, key, text, wanted``: the documents that hold the representatives of ``kinds``."""
    wanted = materialize(kinds.groupBy("id", "key").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "repeat-wanted")  # as many as fit a text
    suspects = docs.filter(_bitmap_udf(docs, wanted)("key")).dropDuplicates(["key", "id"])
    right = wanted.select(F.col("id").alias("i"), F.col("key").alias("k"), "wanted")
    return suspects.join(right, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))).select("id", "key", "text", "wanted")


def _found(docs: DataFrame, kinds: DataFrame, what: Wanted, level: int = 0) -> DataFrame:
    """Repeated strings of each of ``kinds``: its columns ``id, key, g, s, n, first`` and the strings' place ``a, b`` from there."""
    grams = kinds.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("places"), F.min_by("key", "row").alias("top"), F.min_by("at", "row").alias("top_at")).filter("places > 1").drop("places")
    kinds = materialize(kinds.join(materialize(grams, "repeat-grams"), "g"), "repeat-kinds")
    total = kinds.agg(F.coalesce(F.sum(F.when(F.col("m") <= HOT, F.col("last") - F.col("first"))), F.lit(0)), F.max("m")).first()
    shards = max(1, -(-total[0] // SHARD_BYTES))
    bits = F.when(F.col("m") <= FEW, int(np.log2(SHARD_BYTES // FEW))).otherwise(int(np.log2(SHARD_BYTES // HOT)))  # kinds times a block of places make a shard at most
    shard = F.pmod(F.xxhash64("top", bits, F.expr(f"shiftright(top_at, if(m <= {FEW}, {int(np.log2(SHARD_BYTES // FEW))}, {int(np.log2(SHARD_BYTES // HOT))}))")), F.lit(shards))
    cold = kinds.filter(F.col("m") <= HOT).withColumn("shard", shard)
    cut = _of_documents(docs, cold, "shard", "g", "s", "n", "first", "last").mapInArrow(lean(_cut), "id long, key long, shard long, begin long, bytes binary, kinds binary")
    found = materialize(cut.groupBy("shard").applyInArrow(_shard(what), _FOUND), "repeat-found")
    if (total[1] or 0) <= HOT:
        return found
    hot = kinds.filter(F.col("m") > HOT)
    finer = _of_documents(docs, hot, "g", "s", "n", "first", "at", "last").mapInArrow(lean(_finer(what, level + 1)), "id long, key long, up_g long, up_s long, up_first long, g long, s long, n long, first int, at int, last int")
    finer = materialize(finer, "repeat-finer")
    below = _found(docs, _kinds(finer, F.sum("n")), what, level + 1).select("g", "s", "a", "b")
    places = finer.select("g", "s", F.col("up_g"), F.col("up_s"), (F.col("first") - F.col("up_first")).alias("by")).join(below, ["g", "s"])
    places = materialize(places.select(F.col("up_g").alias("g"), F.col("up_s").alias("s"), (F.col("a") + F.col("by")).alias("a"), (F.col("b") + F.col("by")).alias("b")), "repeat-places")
    return found.unionByName(places.join(hot.select("id", "key", "g", "s", "n", F.col("first").cast("long").alias("first")), ["g", "s"]))


def repeated_spans(keyed: DataFrame, what: Wanted = Wanted()) -> DataFrame:
    """``id, key, spans`` (arrays of (words, a, b), unmerged) of the rows of :func:`_keyed` that hold repeated strings."""
    with passing() as keep:
        return keep(_spans(keyed, what))


def _spans(keyed: DataFrame, what: Wanted) -> DataFrame:
    docs = keyed.select(F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("__text").alias("text"))
    marks = materialize(docs.filter(F.octet_length("text") >= what.least).mapInArrow(lean(_anchor_rows(what)), "id long, key long, g long, s long, first int, at int, last int"), "repeat-anchors")
    grams = materialize(marks.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g"), "repeat-shared-grams")  # apart from the join, so that a hot gram's anchors can be split
    shared = materialize(marks.join(grams, "g"), "repeat-shared")
    forget(marks)
    found = _found(docs, _kinds(shared, F.count("*")), what)
    alone = found.filter("n = 1").select("id", "key", "g", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    several = materialize(found.filter("n > 1").select("g", "s", "a", "b"), "repeat-several")
    members = shared.select("id", "key", "g", "s", "first").join(several, ["g", "s"]).select("id", "key", "g", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    places = materialize(members, "repeat-members").unionByName(alone).select("id", "key", F.struct((F.col("g").bitwiseAND(F.lit(1)) == 1).alias("words"), "a", "b").alias("x"))
    return materialize(places.groupBy("id", "key").agg(F.collect_list("x").alias("spans")), "repeat-spans")


def _runs(own: pa.Array, words: bool = False) -> Iterator[list[tuple[int, int]]]:
    """Maximal runs covered by each row's spans, of bytes or of words; a batch can hold millions of spans, so they stay arrays."""
    flat, ends = own.values, own.offsets.to_numpy()
    kind, a, b = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("words", "a", "b"))
    for start, end in zip(ends[:-1], ends[1:]):
        k = start + np.flatnonzero(kind[start:end] == words)
        if not len(k):
            yield []
            continue
        k = k[np.argsort(a[k])]
        far = np.maximum.accumulate(b[k])
        new = np.flatnonzero(np.append(True, a[k[1:]] > far[:-1]))
        yield list(zip(a[k[new]].tolist(), far[np.append(new[1:], len(k)) - 1].tolist()))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def repeat_report(df: DataFrame, id_col: str = "doc_id", min_bytes: int = MIN_BYTES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """One row per row of ``df``: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` of the strings of ``min_bytes`` bytes.

    ``n_passages, passage_bytes`` are of the runs of ``min_words`` words: how many longest stretches of them the text has,
    and the bytes in these. They are found in the same shards; ``n_removed`` and ``kept_sha256`` don't count them.
    """
    keyed = _keyed(df.select(id_col, "text"), id_col)
    spans = repeated_spans(keyed, Wanted(min_bytes, min_words))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs, passages in zip(batch.column("text"), _runs(batch.column("spans")), _runs(batch.column("spans"), True)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept = _kept(raw, runs)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(passages), sum(b - a for a, b in passages)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"])

    moved, still = _suspects(keyed, spans)
    columns = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"
    found = moved.select(F.col("__id").alias("id"), F.col("__text").alias("text"), F.col("__spans").alias("spans")).mapInArrow(lean(report), columns)
    zero = F.lit(0).cast("long")
    whole = still.select(F.col("__id").alias("id"), F.octet_length("__text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("__text").cast("binary"), 256).alias("kept_sha256"), zero.alias("n_passages"), zero.alias("passage_bytes"))
    return found.unionByName(whole).withColumnRenamed("id", id_col)


def _suspects(keyed: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``keyed`` that a bitmap names, joined with their ``__spans`` (or null), and the others, which don't move."""
    inside = _bitmap_udf(keyed, spans)("__key")
    right = spans.select(F.col("id").alias("__i"), F.col("key").alias("__k"), F.col("spans").alias("__spans"))
    moved = keyed.filter(inside).join(right, (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")), "left").drop("__i", "__k")
    return moved, keyed.filter(~inside)


def _bitmap_udf(docs: DataFrame, found: DataFrame):
    """Tells whether a key is in a bitmap of ``found``'s keys (8 MB; a full one only lets more through)."""
    bit = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    rows = found.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP_BITS}) & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def suspect(keys: pd.Series) -> pd.Series:
        at = (keys.to_numpy(np.int64).astype(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return suspect


def without_repeats(df: DataFrame, id_col: str = "doc_id", min_bytes: int = MIN_BYTES, min_words: int | None = None) -> DataFrame:
    """``df`` with repeated strings (with ``min_words``: runs of words) cut from ``text`` (a character that is cut in part goes whole)."""
    keyed = _keyed(df, id_col)
    spans = repeated_spans(keyed, Wanted(None if min_words else min_bytes, min_words))

    @F.arrow_udf("string")
    def cut(text: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array((_kept(x.as_buffer().to_pybytes(), y).decode("utf-8", "ignore") if y else x.as_py() for x, y in zip(text, _runs(own, bool(min_words)))), pa.string())

    moved, still = _suspects(keyed, spans)
    whole = F.col("__whole")
    text = F.when(F.col("__spans").isNotNull(), cut("__text", "__spans")).otherwise(whole.getField("text"))
    moved = moved.select(*(text.alias(c) if c == "text" else whole.getField(c).alias(c) for c in df.columns))
    return moved.unionByName(still.select("__whole.*"))

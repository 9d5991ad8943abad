"""Benchmark decontamination by spaced-seed hashing.

An overlap is a run of words that stands in a document and in a benchmark item, begins and ends with a same word, has
``MIN_WORDS`` words at least, and ``MIN_SAME`` of them the same; the others are substituted. An item of fewer words is
found where all of its words stand in a row.

1. ``MASKS`` select token positions of a short span; the words they ignore may differ. They are chosen so that every
   overlap of 12 to 22 words has a span where one of them sees only same words, however the substitutions lie. All spans
   of the benchmark are hashed under each mask. A bitmap, sized by the counted hashes (``SEED_BITS`` for each, 128 MB at
   most), marks them at ``PROBES`` places each, so that two unrelated words in a thousand pass at most
   (more only where the seeds outgrow the largest bitmap).
2. Training texts are hashed in one narrow pass. Hits in the bitmap that lie close together form a region, which is kept
   with its words (``REACH`` words more on either side).
3. Regions' seed hashes are joined with the benchmark's (which removes the bitmap's false positives). Each
   (region, item, diagonal) is one candidate, however many seeds agree.
4. Each candidate is laid over the item along its diagonal, where the longest overlap is found exactly. ``n_words`` counts
   what lies in the region: beyond ``REACH`` words without a hit an overlap is not followed.

Seeds are joined on their hashes: a passage in a third of all documents makes hot seeds against few benchmark rows, which
Spark broadcasts when small and adaptive execution splits otherwise. Of an exact short item only the first place in each
document goes on.

Defined cases: null texts are empty and hit nothing; an item without words is in no document; repeated items and rows that
repeat both id and text are reported once per (id, item id), rows of one id (or none) with different texts each by
themselves; further columns are ignored or, in :func:`decontaminate`, kept; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, holds, materialize, passing, pieces_of
from msgloom.llm.words import mix, word_hashes

#: Positions that count (1) and are ignored (0); together they miss no overlap of 12 to 22 words (see the tests).
MASKS = ["1111011", "1101111", "110010111", "1101000111", "1010101011", "11011000101", "11100010011", "10000101111", "101011010001"]
SPAN = max(map(len, MASKS))
REACH, MIN_WORDS, MIN_SAME = 64, 12, 0.75
#: Bits of the bitmap for each seed, its least and largest size (as powers of two), and places that a seed marks.
SEED_BITS, LEAST_BITS, MOST_BITS, PROBES = 32, 20, 30, 4
BATCH_BYTES = 1 << 20
_STEP = np.uint64(0xE7037ED1A0B428DB)


def seeds(words: np.ndarray, counts: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of every span that lies in one text: each mask, then exact runs of each of ``lengths``."""
    end = np.repeat(np.cumsum(counts), counts)
    for kind, mask in enumerate([*MASKS, *("1" * n for n in lengths)]):
        at = np.flatnonzero(np.arange(len(words)) + len(mask) <= end)
        h = np.full(len(at), np.uint64(kind if kind < len(MASKS) else 100 + len(mask)))
        for j, bit in enumerate(mask):
            if bit == "1":
                h = (h + words[at + j]) * _STEP
                h ^= h >> np.uint64(31)
        yield at, mix(h)


def _spot(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit that seeds mark at one of their places in a bitmap of ``2**bits``."""
    return ((h + np.uint64(probe) * (h * _STEP | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def longest_overlap(same: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest run (the first of equal ones) that begins and ends with a same word and has ``MIN_SAME`` of them."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    total = np.arange(1, len(at) + 1) - MIN_SAME * (at + 1)  # same words up to a place, less what a run up to there needs
    before = total - 1 + MIN_SAME  # the same in front of the place
    least = np.minimum.accumulate(before)
    first = np.searchsorted(-least, -(total + 1e-9), "left")  # the first start that a run to each end can have
    size = at - at[first]
    k = int(size.argmax())
    return int(at[first[k]]), int(at[k]) + 1


def _words_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffer_of(batch.column(column))
    for start, end in pieces_of(batch, column, BATCH_BYTES):
        yield start, end, *word_hashes(data, offsets[start : end + 1])


def _items(benchmark: DataFrame, item_col: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark rows with their words, and their seeds."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, words, counts in _words_of(batch, "text"):
                ends = np.cumsum(counts)
                lists = [words[b - c : b].astype("<u8").tobytes() for b, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(start, end - start), pa.array(lists, pa.binary()), pa.array(counts, pa.int64())], ["item_id", "item_words", "n"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("item_words").to_pylist()):
                words = np.frombuffer(raw, "<u8")
                for at, h in seeds(words, np.asarray([len(words)]), [len(words)] if len(words) < MIN_WORDS else []):
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.full(len(at), item)), pa.array(at)], ["h", "item", "item_at"])

    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).mapInArrow(hashed, "item_id long, item_words binary, n long")
    own = materialize(own.filter("n > 0").withColumn("item", F.monotonically_increasing_id()), "leak-items")
    return own, materialize(own.select("item", "item_words").mapInArrow(spans, "h long, item long, item_at long"), "leak-seeds")


def _bitmap(marks: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of the seeds, eight bits to a byte, and its size as a power of two; words are joined by OR before they arrive."""
    bits = min(max(LEAST_BITS, int(np.ceil(np.log2(max(1, SEED_BITS * marks.count()))))), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.uint64)
            at = np.concatenate([_spot(h, j, bits) for j in range(PROBES)])
            word, own = np.unique(at >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.int64)
            np.bitwise_or.at(mask, own, np.int64(1) << (at & 63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], ["word", "mask"])

    rows = marks.select("h").mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return out.view(np.uint8), bits


def _regions(docs: DataFrame, shared, bits: int, lengths: list[int]) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value

        def marked(bit: np.ndarray) -> np.ndarray:
            return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids = batch.column("id")
            for start, end, words, counts in _words_of(batch, "text"):
                ats, hs = [], []
                for k, (at, h) in enumerate(seeds(words, counts, lengths)):
                    hit = np.arange(len(h))
                    for j in range(PROBES):
                        hit = hit[marked(_spot(h[hit], j, bits))]
                    if k >= len(MASKS):  # whole short items: the first place in each document
                        own = np.searchsorted(np.cumsum(counts), at[hit], "right")
                        hit = hit[np.unique(np.stack([own.astype(np.uint64), h[hit]]), axis=1, return_index=True)[1]]
                    ats.append(at[hit])
                    hs.append(h[hit])
                at, h = np.concatenate(ats), np.concatenate(hs)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, "right")
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > REACH)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))
                rows, begins, slices, hashes, places = [], [], [], [], []
                for a, b in zip(first.tolist(), last.tolist()):
                    d = doc[a]
                    lo, hi = max(at[a] - REACH, ends[d] - counts[d]), min(at[b - 1] + SPAN + REACH, ends[d])
                    rows.append(start + d)
                    begins.append(lo - (ends[d] - counts[d]))
                    slices.append(words[lo:hi].astype("<u8").tobytes())
                    hashes.append(h[a:b].astype(np.int64))
                    places.append(at[a:b] - lo)
                lists = pa.array([[{"h": int(x), "at": int(y)} for x, y in zip(p, q)] for p, q in zip(hashes, places)], pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64())])))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), batch.column("key").take(pa.array(rows)), pa.array(begins, pa.int64()), pa.array(slices, pa.binary()), lists], ["id", "key", "begin", "words", "hits"])

    return docs.mapInArrow(find, "id long, key long, begin long, words binary, hits array<struct<h:long,at:long>>")


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "key", "item_id", "n_words", "n_same", "start"]
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "item_id", "begin", "words", "item_words", "diagonal"))):
            id_, key, item, begin, raw, raw_item, diagonal = row
            words, own = np.frombuffer(raw, "<u8"), np.frombuffer(raw_item, "<u8")
            lo, hi = max(0, -diagonal), min(len(own), len(words) - diagonal)
            same = own[lo:hi] == words[lo + diagonal : hi + diagonal]
            a, b = longest_overlap(same)
            if b - a >= MIN_WORDS or len(own) < MIN_WORDS and b - a == len(own) and same.all():
                out.append((id_, key, item, b - a, int(same[a:b].sum()), begin + lo + diagonal + a))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, names)


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """The columns of ``docs``, under any names, as ``__whole``, with ``__id``, ``__text``, and ``__key``, which tells rows of one id with different texts apart."""
    df = docs.select(F.struct("*").alias("__whole"), F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    return df.withColumn("__key", F.xxhash64("__id", "__text"))


def _overlaps(keyed: DataFrame, benchmark: DataFrame, item_col: str) -> DataFrame:
    items, marks = _items(benchmark, item_col)
    lengths = [r["n"] for r in items.filter(F.col("n") < MIN_WORDS).select("n").distinct().collect()]
    bitmap, bits = _bitmap(marks)
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)
    text = keyed.select(F.col("__id").alias("id"), F.col("__key").alias("key"), F.lower("__text").alias("text"))
    regions = materialize(_regions(text, shared, bits, sorted(lengths)).withColumn("region", F.monotonically_increasing_id()), "leak-regions")
    hits = regions.select("region", F.explode("hits").alias("x")).select("region", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    candidates = hits.join(marks, "h").select("region", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    laid = candidates.join(regions.select("region", "id", "key", "begin", "words"), "region").join(items.select("item", "item_id", "item_words"), "item")
    found = laid.mapInArrow(_lay, "id long, key long, item_id long, n_words long, n_same long, start long")
    best = F.max(F.struct("n_same", "n_words", (-F.col("start")).alias("place"))).alias("x")
    found = found.groupBy("id", "key", "item_id").agg(best)
    return materialize(found.select("id", "key", "item_id", F.col("x.n_words").alias("n_words"), F.col("x.n_same").alias("n_same"), (-F.col("x.place")).alias("start")), "leak-found")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """``id_col, item_id, n_words, n_same, start``: the best overlap of each document with each item it holds."""
    with passing() as keep:
        found = keep(_overlaps(_keyed(docs.select(id_col, "text"), id_col), benchmark, item_col))
    return found.select(F.col("id").alias(id_col), "item_id", "n_words", "n_same", "start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage: only rows that a bitmap of those suspects are joined."""
    keyed = _keyed(docs, id_col)
    with passing() as keep:
        found = keep(_overlaps(keyed, benchmark, "item_id"))
    leaks = found.select(F.col("key").alias("__leak"), F.col("id").alias("__leak_id")).distinct()
    inside = holds(leaks.select("__leak"))
    suspects = keyed.filter(inside("__key")).join(leaks, (F.col("__key") == F.col("__leak")) & F.col("__id").eqNullSafe(F.col("__leak_id")), "left_anti")
    return keyed.filter(~inside("__key")).unionByName(suspects).select("__whole.*")

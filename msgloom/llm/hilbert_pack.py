"""Packing along a space-filling curve: documents that are near in content share sequences.

1. Each document's token ids are hashed to buckets and projected to ``DIMS`` dimensions by fixed random directions.
2. Every dimension is scaled by its mean and deviation over all documents and cut into ``2**BITS`` levels; the point's
   Hilbert index is the document's key.
3. Documents are range-sorted by (key, doc_id). Laid end to end along the curve, their ids are cut every ``width`` ids:
   each document's global start gives the sequences, offsets and pieces, so only the last sequence can need padding.

Only (row number, key, size) is sorted; ids are joined to their starts once. Equal keys (copies) are ordered by doc_id,
and a range can break inside them, so no key has to fit one task.

Defined cases: a null text is empty and gives the end id alone; repeated rows are separate documents; a null doc_id
sorts first; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, materialize, passing, pieces_of, running_start, text_or_empty
from msgloom.llm.rans_ids import BATCH_BYTES, packed, unpacked

DIMS, BITS, BUCKETS, SEED = 4, 10, 1 << 13, 20231


def directions(dims: int = DIMS, buckets: int = BUCKETS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype(np.float32)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of integer points, one row each (Skilling's transpose form, vectorised over rows)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokens(df: DataFrame, tokenizer: str, end_id: int | None, batch_bytes: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from msgloom.llm.pieces import encoder_for

        encoder, axes = encoder_for(tokenizer), directions()
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for start, end in pieces_of(batch, "text", batch_bytes):
                counts, ids = encoder.runs(data, offsets[start : end + 1])
                bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
                ends = np.cumsum(counts)
                points = []
                for k in range(DIMS):
                    total = np.concatenate([[0.0], np.cumsum(axes[bucket, k], dtype=np.float64)])
                    points.append(np.round((total[ends] - total[ends - counts]) / np.maximum(counts, 1), 9))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), *packed(counts, ids, end_id), *map(pa.array, points)], ["doc_id", "n_tokens", "ids", *(f"v{k}" for k in range(DIMS))])

    schema = "doc_id long, n_tokens long, ids binary, " + ", ".join(f"v{k} double" for k in range(DIMS))
    return text_or_empty(df, "doc_id").mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id())


def pack(df: DataFrame, tokenizer: str, width: int = 1024, end_id: int | None = 0, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    with passing() as keep:
        return keep(materialize(_pieces(df, tokenizer, width, end_id, batch_bytes), "pack-pieces"))


def _pieces(df: DataFrame, tokenizer: str, width: int, end_id: int | None, batch_bytes: int) -> DataFrame:
    tokens = materialize(_tokens(df, tokenizer, end_id, batch_bytes), "pack-tokens")
    dims = [f"v{k}" for k in range(DIMS)]
    scale = tokens.agg(*(F.avg(v) for v in dims), *(F.stddev_pop(v) for v in dims)).first()  # 2 * DIMS numbers
    mean, deviation = [x or 0.0 for x in scale[:DIMS]], [x or 1.0 for x in scale[DIMS:]]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        levels = [np.floor((1 << BITS) / (1 + np.exp(-1.702 * np.clip((c.to_numpy() - m) / d, -30, 30)))) for c, m, d in zip(columns, mean, deviation)]
        return pd.Series(hilbert_index(np.clip(np.stack(levels, 1), 0, (1 << BITS) - 1)))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("n_tokens"), pa.array(ends - sizes)], ["row", "part", "n_tokens", "local"])
            at = int(ends[-1]) if len(ends) else at

    keyed = tokens.select("row", "doc_id", "n_tokens", curve(*dims).alias("key"))
    line = keyed.repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row").withColumn("part", F.spark_partition_id())
    line = materialize(line.select("row", "part", "n_tokens").mapInArrow(starts, "row long, part int, n_tokens long, local long"), "pack-line")
    placed = line.join(running_start(line, "part", "n_tokens", "base"), "part").select("row", (F.col("base") + F.col("local")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("ids"))
            out: list[tuple] = []
            for i, (key, at) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist())):
                ids = unpacked(data[offsets[i] : offsets[i + 1]].copy(), 0, int(offsets[i + 1] - offsets[i]))
                raw = memoryview(ids.astype("<u4").tobytes())
                a = 0
                while a < len(ids):
                    sequence, offset = divmod(at + a, width)
                    b = min(len(ids), a + width - offset)
                    out.append((key, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(ids), sequence, offset))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, PIECE)

    pieces = tokens.select("row", "doc_id", "ids").join(placed.hint("shuffle_hash"), "row").select("doc_id", "ids", "at")
    return pieces.mapInArrow(cut, ", ".join(f"{c} long" for c in PIECE))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

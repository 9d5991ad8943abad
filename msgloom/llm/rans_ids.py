"""Token ids on disk, entropy coded: a static range asymmetric numeral system over interleaved blocks.

Layout of a written dataset (``write_ids``):

* ``tokens``   - working table of ids, one row per document, removed at the end;
* ``table``    - one row per token id: its frequency over the whole corpus, scaled to a power of two;
* ``blocks``   - Parquet rows ``part, block, n_ids, frame``; ``(part, block)`` order is ascending document order.

A frame stands alone given the shared table::

    "RNSB", version u8, log2 of scale u8, lanes u16, checkpoint steps u32, n_docs u32, n_ids u64, n_words u64
    document ids i64[n_docs], their validity u8[n_docs], ids of each document u32[n_docs]
    checkpoints: word offset u64[k], lane states u64[k, lanes]
    words u32[n_words]
    crc32 of everything before, u32

Id ``i`` of a block belongs to lane ``i mod lanes``; every lane is a 64-bit state, renormalised by 32-bit words that all
lanes share in one stream. States are kept every ``checkpoint steps`` rows of lanes, so a reader can start at any of
them; ``decode_frame`` decodes from all checkpoints of a block at once.

Defined cases: a null text is empty and has the end id alone; a null document id sorts first and stays null; repeated
rows are separate documents, in any order among themselves; a document longer than a block makes a longer block; an empty
table gives empty files and no rows; a changed block fails its checksum. Pieces of text are looked up by 64-bit hashes
(:mod:`msgloom.llm.pieces`).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, materialize, passing, pieces_of, running_start, text_or_empty

SCALE_BITS, LANES, CHECKPOINT_STEPS, BLOCK_IDS = 20, 512, 256, 1 << 18
BATCH_BYTES = 2 << 20
_HEAD = struct.Struct("<4sBBHIIQQ")
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


# -- the shared table --------------------------------------------------------------------------------------------------


def scale_counts(ids: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to ``2**bits``, in proportion to ``counts`` (largest entries take the rest)."""
    total = 1 << bits
    if len(ids) > total:
        raise ValueError(f"{len(ids)} different ids do not fit a scale of {total}")
    if not len(ids):
        return np.zeros(0, np.int64)
    share = counts.astype(np.float64) / counts.sum()
    freq = np.maximum(1, np.floor(share * (total - len(ids))).astype(np.int64))
    order = np.lexsort((ids, -counts))
    rest = total - int(freq.sum())
    freq[order[0]] += max(rest, 0)
    for i in order if rest < 0 else ():
        take = min(-rest, int(freq[i]) - 1)
        freq[i] -= take
        rest += take
        if rest == 0:
            break
    return freq


class Table:
    """Frequencies, their running sums, and the id of each slot."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))


# -- one frame -----------------------------------------------------------------------------------------------------------


def encode_frame(ids: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, sizes: np.ndarray, table: Table, lanes: int = LANES, steps: int = CHECKPOINT_STEPS) -> bytes:
    """``ids`` of the documents ``doc_ids`` (``sizes`` of them each) as one frame."""
    bits = np.uint64(table.bits)
    state = np.full(lanes, _LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    highest = freq << np.uint64(63 - table.bits)
    n_steps = -(-len(ids) // lanes)
    words, kept = [], {}
    for t in range(n_steps - 1, -1, -1):
        a, b = t * lanes, min((t + 1) * lanes, len(ids))
        x, f = state[: b - a], freq[a:b]
        full = x >= highest[a:b]
        words.append(x[full].astype(np.uint32))  # the low half
        x = np.where(full, x >> _32, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + start[a:b]
        if t % steps == 0:
            kept[t] = state.copy()
    words.reverse()
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint64) if words else np.zeros(1, np.uint64)
    marks = sorted(kept)
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    body = b"".join([
        _HEAD.pack(b"RNSB", 1, table.bits, lanes, steps, len(doc_ids), len(ids), len(stream)),
        doc_ids.astype("<i8").tobytes(), valid.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(),
        np.asarray([at[t] for t in marks], "<u8").tobytes(), b"".join(kept[t].astype("<u8").tobytes() for t in marks),
        stream.astype("<u4").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(frame: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids, document ids, validity, sizes`` of a frame; all checkpoints are decoded side by side."""
    if struct.unpack("<I", frame[-4:])[0] != zlib.crc32(memoryview(frame)[:-4]):
        raise ValueError("a block's checksum does not match")
    magic, version, bits, lanes, steps, n_docs, n_ids, n_words = _HEAD.unpack_from(frame)
    if magic != b"RNSB" or version != 1 or bits != table.bits:
        raise ValueError("not a block of this format and table")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(frame, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, valid, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    n_steps = -(-n_ids // lanes)
    k = -(-n_steps // steps)
    where, state = take("<u8", k).astype(np.int64), take("<u8", k * lanes).reshape(k, lanes).astype(np.uint64)
    words = np.concatenate([take("<u4", n_words), np.zeros(lanes, np.uint32)]).astype(np.uint64)
    ids = np.zeros((k, steps, lanes), np.uint32)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    for t in range(min(steps, n_steps)):
        live = k if (k - 1) * steps + t < n_steps else k - 1  # the last run may be shorter
        x = state[:live]
        low = x & mask
        got = table.slot[low.astype(np.int64)]
        ids[:live, t] = got
        y = table.freq[got] * (x >> shift) + low - table.start[got]
        if live and live == k and (k - 1) * steps + t == n_steps - 1 and n_ids % lanes:
            y[-1, n_ids % lanes :] = x[-1, n_ids % lanes :]  # lanes without an id in the last row
        need = y < _LOW
        order = np.cumsum(need, axis=1) - need
        read = words[np.minimum(where[:live, None] + order, len(words) - 1)]
        state[:live] = np.where(need, (y << _32) | read, y)
        where[:live] += need.sum(axis=1)
    return ids.reshape(-1)[:n_ids], doc_ids, valid, sizes


# -- Spark jobs ----------------------------------------------------------------------------------------------------------


def encode_ids(df: DataFrame, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id_col, n_tokens, ids`` (little-endian, two bytes an id where the vocabulary allows it, else four)."""
    return _encoded(df, tokenizer, end_id, id_col, batch_bytes).filter("counts is null").drop("counts")


def _encoded(df: DataFrame, tokenizer: str, end_id: int | None, id_col: str, batch_bytes: int) -> DataFrame:
    """:func:`encode_ids`, and from each task one row more that has only ``counts``: its ids and how often each occurs."""
    names = [id_col, "n_tokens", "ids", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from msgloom.llm.pieces import encoder_for

        encoder, total = encoder_for(tokenizer), np.zeros(1 << 16, np.int64)

        def count(ids: np.ndarray) -> None:
            nonlocal total
            own = np.bincount(ids)
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own

        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for start, end in pieces_of(batch, "text", batch_bytes):
                counts, ids = encoder.runs(data, offsets[start : end + 1])
                count(ids)
                if end_id is not None:
                    count(np.full(end - start, end_id))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(start, end - start), *packed(counts, ids, end_id), pa.nulls(end - start, pa.binary())], names)
        seen = np.flatnonzero(total)
        both = np.stack([seen, total[seen]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([both])], names)

    return text_or_empty(df, id_col).mapInArrow(encode, f"`{id_col}` long, n_tokens long, ids binary, counts binary")


def packed(counts: np.ndarray, ids: np.ndarray, end_id: int | None) -> tuple[pa.Array, pa.Array]:
    """Counts with the end id, and each document's ids as bytes: a width byte (2 or 4), then the ids."""
    if end_id is not None:
        ends = np.cumsum(counts)
        ids = np.insert(ids, ends, end_id)
        counts = counts + 1
    ends = np.cumsum(counts)
    starts = ends - counts
    most = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        most[some] = np.maximum.reduceat(ids, starts[some])
    raw, wide = ids.astype("<u2").tobytes(), ids.astype("<u4").tobytes() if (most >= 65536).any() else b""
    out = [b"\2" + raw[2 * a : 2 * b] if m < 65536 else b"\4" + wide[4 * a : 4 * b] for a, b, m in zip(starts.tolist(), ends.tolist(), most.tolist())]
    return pa.array(counts, pa.int64()), pa.array(out, pa.binary())


def unpacked(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """The ids of one document from a buffer of :func:`packed` bytes."""
    return data[start + 1 : end].view("<u2" if data[start] == 2 else "<u4") if end > start else np.zeros(0, "<u2")


def frequencies(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents, from the tasks' totals."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    return tokens.filter("counts is not null").select("counts").mapInArrow(apart, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(df: DataFrame, tokenizer: str, end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Encode ``doc_id, text`` and write the dataset; returns its ``table`` and ``blocks``, read from the files.

    The table has one row per different token id, so the vocabulary bounds what the driver sees and broadcasts.
    """
    with passing() as keep:
        table, blocks = _written(df, tokenizer, end_id, block_ids)
        return keep(table), keep(blocks)


def _written(df: DataFrame, tokenizer: str, end_id: int | None, block_ids: int) -> tuple[DataFrame, DataFrame]:
    tokens = materialize(_encoded(df, tokenizer, end_id, "doc_id", BATCH_BYTES).withColumn("row", F.monotonically_increasing_id()), "tokens")
    table = materialize(frequencies(tokens), "rans-table")
    symbols = _load(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, block, hold, n = symbols.value, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, hold, n
            keys = [x[0] for x in hold]
            frame = encode_frame(np.concatenate([x[1] for x in hold]).astype(np.int64), np.asarray([k or 0 for k in keys], np.int64), np.asarray([k is not None for k in keys]), np.asarray([len(x[1]) for x in hold]), own)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([frame], pa.binary())], ["part", "block", "n_ids", "frame"])
            block, hold, n = block + 1, [], 0
            return out

        for batch in batches:
            data, offsets = buffer_of(batch.column("ids"))
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                ids = unpacked(data[offsets[i] : offsets[i + 1]].copy(), 0, int(offsets[i + 1] - offsets[i]))
                hold.append((key, ids))
                n += len(ids)
                if n >= block_ids:
                    yield flush()
        if hold:
            yield flush()

    # copies of one doc_id are told apart by row, so that a range can break between them
    ordered = tokens.filter("counts is null").select("doc_id", "row", "ids").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered = ordered.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    return table, materialize(ordered.mapInArrow(encode, "part int, block int, n_ids long, frame binary"), "rans-blocks", "none")


def _load(table: DataFrame):
    """The shared table as a broadcast of at most the vocabulary's size."""
    rows = table.orderBy("id").toPandas()
    ids, counts = rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    return table.sparkSession.sparkContext.broadcast(Table(ids, scale_counts(ids, counts)))


def read_ids(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the files in parallel by block."""
    symbols = _load(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = symbols.value
        for batch in batches:
            for part, first, frame in zip(batch.column("part_start").to_pylist(), batch.column("block_start").to_pylist(), batch.column("frame")):
                ids, doc_ids, valid, sizes = decode_frame(frame.as_py(), own)
                ends = np.cumsum(sizes.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=valid == 0), pa.array(part + first + ends - sizes), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    from pyspark.sql.window import Window

    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("part", "block", "n_ids").withColumn("block_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).drop("n_ids")
    index = index.join(running_start(blocks, "part", "n_ids", "part_start"), "part")
    return blocks.join(index, ["part", "block"]).select("part_start", "block_start", "frame").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Token counts: Arrow batch encoding that returns lengths only.

Each Arrow batch is cut into runs of rows of about ``batch_bytes`` bytes, so that a batch of long texts costs no more
memory than one of short texts. Inside a run every text, long or short, is split at safe boundaries (see
:mod:`msgloom.llm.pieces`), distinct pieces are encoded once, and only the number of ids leaves the function. The job is
one narrow stage: no shuffle, whatever the sizes of keys or groups.

Defined cases: a null text counts as the empty one (0 bytes, 0 tokens); repeated rows give repeated rows; a null id
stays null; further columns are ignored; an empty table gives an empty table. Pieces are looked up by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm._io import buffer_of, pieces_of, text_or_empty

BATCH_BYTES = 2 << 20


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of each row's ``text`` under the tokenizer file ``tokenizer``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from msgloom.llm.pieces import encoder_for

        encoder = encoder_for(tokenizer)
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for start, end in pieces_of(batch, "text", batch_bytes):
                at = offsets[start : end + 1]
                counts, _ = encoder.runs(data, at, ids=False)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(start, end - start), pa.array(at[1:] - at[:-1]), pa.array(counts)], [id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    counted = text_or_empty(df, id_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

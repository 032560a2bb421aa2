"""Token ids and token counts of whole corpora."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.bpe import ByteBpe

#: Where the public vocabularies are, unless a call says otherwise.
TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts of one step of encoding; only bounds the memory of a step.
STEP = 256

_ENCODERS: dict[int, ByteBpe] = {}


def _encoder(shared) -> ByteBpe:
    """One encoder per worker process, made of the broadcast vocabulary."""
    made = _ENCODERS.get(shared.id if hasattr(shared, "id") else 0)
    if made is None:
        _ENCODERS.clear()
        made = _ENCODERS[shared.id if hasattr(shared, "id") else 0] = ByteBpe(shared.value)
    return made


def _shared(df: DataFrame, tokenizers: str, vocabulary: str):
    """The vocabulary file, under a MB whatever the corpus is, sent to all executors once."""
    with open(os.path.join(tokenizers, vocabulary), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): each row's ids by a byte-level BPE vocabulary, without special tokens.

    Null and empty texts give an empty list, never null; whole texts of any length are encoded;
    repeated rows and null keys stay as they are. One pass, no shuffle.
    """
    shared = _shared(df, tokenizers, vocabulary)

    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                ids, ends = encoder.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], [key, "ids"]
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` BIGINT of each row; null and empty texts have 0."""
    shared = _shared(df, tokenizers, vocabulary)

    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                n = np.array([len(encoder.encode(t)) for t in part.column(len(keep)).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(n)], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint")

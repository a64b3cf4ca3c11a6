"""Ingest as one plan: documents to gated, chunked, embedded rows, and the incremental parts of it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import JUNK_PATTERNS, sanity_flags
from tessera.operators.chunking import chunked

BLOCKING = ("too_large", *JUNK_PATTERNS)
DIM = 64
EMBEDDER = "hashed-words"


@F.arrow_udf(T.ArrayType(T.FloatType()))
def hashed_embedding(text: pa.Array) -> pa.Array:
    """Word counts hashed into DIM places: a deterministic stand-in for a model."""
    counts = np.zeros((len(text), DIM), dtype=np.float32)
    for i, t in enumerate(text):  # one text at a time is a Python string
        places = [zlib.crc32(w.encode()) % DIM for w in re.findall(r"[^\W_]+", (t.as_py() or "").lower())]
        counts[i] = np.bincount(np.array(places, dtype=np.int64), minlength=DIM)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * DIM), pa.array(counts.ravel()))


def gated(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents to index, with their flags, and documents in quarantine."""
    flagged = docs.withColumn("flags", sanity_flags(F.col(text_col)))
    blocked = F.arrays_overlap("flags", F.array(*map(F.lit, BLOCKING)))
    return flagged.where(~blocked), flagged.where(blocked)


def ingested(docs: DataFrame, id_col: str = "doc_id", embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """(doc_id, chunk_index, content, content_hash, embedding, signature) of documents that pass the gate."""
    chunks = chunked(gated(docs)[0], id_col)
    return chunks.withColumns({"content_hash": F.md5("content"), "embedding": embed(F.col("content")), "signature": F.lit(f"{EMBEDDER}:{DIM}")})


def chunks_to_embed(chunks: DataFrame, vectors: DataFrame, signature: str) -> DataFrame:
    """Chunks (content_hash) without a vector of the current signature; equal content has one vector."""
    return chunks.join(vectors.where(F.col("signature") == signature).select("content_hash"), "content_hash", "left_anti")


def stale_vectors(vectors: DataFrame, signature: str) -> DataFrame:
    return vectors.where(F.col("signature") != signature)


def stale_chunks(docs: DataFrame, version: int) -> DataFrame:
    """Documents chunked by an older version."""
    return docs.where(F.coalesce("chunker_version", F.lit(0)) < version)


def replaced_chunks(stored: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored chunks with those of the documents in ``fresh`` replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)

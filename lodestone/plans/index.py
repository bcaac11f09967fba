"""Corpus to index, in one lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.tokenize import words
from ..operators import bm25, chunk
from ..runtime import kept


def build(docs: DataFrame, id_col: str, source_col: str, text_col: str = "text", tokenizer: Callable[[Column], Column] = words, config: EngineConfig | None = None) -> tuple[DataFrame, bm25.Index]:
    """Chunks (id, doc, chunk_no, source, text) and their index; nothing to index is an error.

    A chunk's id comes from its document's and its place, so it does not depend
    on the order of a scan. Nothing is shuffled before the term counts.
    """
    config = config or EngineConfig()
    parts = chunk.chunks(docs.where(F.trim(F.coalesce(text_col, F.lit(""))) != ""), id_col, text_col, config.chunk_size, config.chunk_overlap)
    parts = chunk.with_context(parts, id_col)
    names = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"))
    parts = parts.join(names, F.col(id_col) == F.col("doc")).select((F.col("doc").cast("long") * (1 << 24) + F.col("chunk_no")).alias("id"), "doc", "chunk_no", "source", "text")
    parts = kept(parts)
    if parts.isEmpty():
        raise ValueError("there is nothing to index")
    return parts, bm25.build(parts, "id", tokenizer(F.col("text")))

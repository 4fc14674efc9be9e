"""Chunking of documents: overlapping token windows, character windows, and splits at paragraphs, lines and words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, CHARS, CHAR_OVERLAP, MAX_DOCS = 1000, 200, 1200, 400, 30
#: What splits are made at, the coarsest first, and their size and overlap.
SEPARATORS, SPLIT_CHARS, SPLIT_OVERLAP = ("\n\n", "\n", " ", ""), 4000, 400


def token_windows(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_pos, text: windows of `size` white-space tokens, each `size - overlap` after the last, until one reaches the end."""
    step = size - overlap
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    rows = documents.select("doc_id", tokens.alias("_t")).where("size(_t) > 0")
    count = F.greatest(F.lit(1), F.ceil((F.size("_t") - size) / step).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice("_t", k * step + 1, F.lit(size)), " "))
    return rows.select("doc_id", F.posexplode(starts).alias("chunk_pos", "text"))


def char_windows(documents: DataFrame, size: int = CHARS, overlap: int = CHAR_OVERLAP, max_docs: int | None = None) -> DataFrame:
    """doc_id, chunk_pos, text: windows of `size` characters; at most the first max_docs of each document."""
    step = size - overlap
    rows = documents.select("doc_id", "text").where("text <> ''")
    count = F.greatest(F.lit(1), F.ceil((F.char_length("text") - size) / step).cast("int") + 1)
    if max_docs is not None:
        count = F.least(count, F.lit(max_docs))
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substr(F.col("text"), k * step + 1, F.lit(size)))
    return rows.select("doc_id", F.posexplode(starts).alias("chunk_pos", "text"))


def split_text(text: str, size: int = SPLIT_CHARS, overlap: int = SPLIT_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that occurs and finer ones where parts are longer.

    A part keeps the separator before it. Parts are joined up to the size; the next chunk begins with as many of the last
    parts as fit into the overlap. Chunks are stripped, empty ones left out.
    """
    if not text:
        return []
    at = next(k for k, s in enumerate(separators) if not s or s in text)
    mark, finer = separators[at], separators[at + 1 :]
    cuts = text.split(mark) if mark else list(text)
    parts = [p for p in [cuts[0], *(mark + c for c in cuts[1:])] if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for part in parts:
        if len(part) >= size and finer:
            close()
            held, length = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        if held and length + len(part) > size:
            close()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    close()
    return out


def text_splits(documents: DataFrame, size: int = SPLIT_CHARS, overlap: int = SPLIT_OVERLAP) -> DataFrame:
    """doc_id, chunk_pos, text by split_text, in Arrow batches; null and blank texts give none."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                if chunks := split_text(text, size, overlap) if text else []:
                    ids = batch.column("doc_id").slice(k, 1).take(pa.array([0] * len(chunks)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(chunks)), pa.int32()), pa.array(chunks)], ["doc_id", "chunk_pos", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_pos int, text string")


def as_documents(chunks: DataFrame, column: str = "text") -> DataFrame:
    """chunks as documents with a string column `text`: an error if there are none, if the column isn't text, or where a text is null or blank."""
    if column not in chunks.columns or chunks.schema[column].dataType.simpleString() != "string":
        raise TypeError(f"chunks must have a text column {column}")
    if not chunks.take(1):
        raise ValueError("there are no chunks")
    text = F.when(F.trim(F.coalesce(column, F.lit(""))) != "", F.col(column)).otherwise(F.raise_error(F.lit("a chunk has no text")))
    return chunks.withColumn("text", text)

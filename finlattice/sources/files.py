"""Files: PDFs through a pluggable parser, text and chunk sinks, and the choice between table sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a PDF -> text of its pages.
PageParser = Callable[[bytes], list[str]]


def fitz_pages(content: bytes) -> list[str]:
    """Pages by PyMuPDF, where it is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document]


def read_pdfs(spark: SparkSession, path: str, parser: PageParser = fitz_pages) -> DataFrame:
    """path, text: the joined pages of each .pdf file; null where the parser fails. Spark lists and reads the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = []
            for content in part["content"]:
                try:
                    texts.append("".join(parser(content)))
                except Exception:  # noqa: BLE001  a broken file is a null text
                    texts.append(None)
            yield pd.DataFrame({"path": part["path"], "text": texts})

    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def encrypted(spark: SparkSession, path: str) -> DataFrame:
    """path, encrypted: whether a PDF's trailer names an encryption dictionary; null for what isn't a PDF."""
    files = spark.read.format("binaryFile").load(path)
    raw = F.decode("content", "ISO-8859-1")
    return files.select("path", F.when(F.startswith(raw, F.lit("%PDF")), F.contains(raw, F.lit("/Encrypt"))).alias("encrypted"))


def save_text(texts: DataFrame, path: str, column: str = "text") -> None:
    """One line a row."""
    texts.select(column).write.mode("overwrite").text(path)


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks in order, a line each; the order holds within each file."""
    chunks.repartitionByRange("doc_id", "chunk_pos").sortWithinPartitions("doc_id", "chunk_pos").select("text").write.mode("overwrite").text(path)


def save_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def choose_table_source(prefer_local: bool, has_parse_key: bool, has_vision_key: bool) -> str:
    """local if preferred, else the parsing service, else the image model, else local."""
    if prefer_local:
        return "local"
    return "parse" if has_parse_key else "vision" if has_vision_key else "local"


def vision_model(has_openai_key: bool) -> str:
    return "gpt-4o" if has_openai_key else "claude"


def page_images(pages: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Pages of documents that an image model is asked about: all, or those wanted that exist (from 1)."""
    if wanted is None:
        return pages
    return pages.where(F.col("page").isin(wanted) & F.col("page").between(1, F.col("n_pages")))


def page_responses(spark: SparkSession, path: str, render: Callable[[bytes], list[bytes]], ask: Callable[[bytes], str], wanted: list[int] | None = None) -> DataFrame:
    """doc_id (the path), page, response: what an image model says of each page of each .pdf file.

    render: bytes of a PDF -> images of its pages. Pages are numbered from 1; of those wanted only those that exist are asked
    about, and all if none are named. A page that fails has a null response, a file that fails no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for name, content in zip(part["path"], part["content"]):
                try:
                    images = render(content)
                except Exception:  # noqa: BLE001  a broken file has no pages
                    continue
                for page in range(1, len(images) + 1) if wanted is None else [p for p in wanted if 1 <= p <= len(images)]:
                    try:
                        rows.append((name, page, ask(images[page - 1])))
                    except Exception:  # noqa: BLE001  what a remote model raises isn't known here
                        rows.append((name, page, None))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "response"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, response string")


class TableReader:
    """Tables of documents from one source, chosen by what is there and built when first used.

    Each source is a function without arguments that makes a reader (documents -> tables), or None where it has no credentials.
    """

    def __init__(self, local: Callable[[], Callable], parse: Callable[[], Callable] | None = None, vision: Callable[[], Callable] | None = None, prefer_local: bool = False):
        self._sources = {"local": local, "parse": parse, "vision": vision}
        self.source = choose_table_source(prefer_local, parse is not None, vision is not None)
        self._readers: dict[str, Callable] = {}

    def read(self, documents: DataFrame) -> DataFrame:
        if self.source not in self._readers:
            self._readers[self.source] = self._sources[self.source]()
        return self._readers[self.source](documents)

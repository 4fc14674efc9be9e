"""Tables found on pages: cells from words with their boxes, by bands of rows and gaps between columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In heights of a line: how far words of one cell may stand apart, and rows of one table.
CELL_GAP, ROW_GAP = 1.2, 2.5
#: Pages whose tables are handed on at once.
PAGES = 256

Word = tuple[float, float, float, float, str]


def bands(words: list[Word]) -> list[list[Word]]:
    """Words (x0, top, x1, bottom, text) in lines from top to bottom, each from left to right.

    A word belongs to the line whose middle its own height covers; lines don't overlap in text that stands upright.
    """
    lines: list[list[Word]] = []
    low = high = 0.0
    for word in sorted(words, key=lambda w: ((w[1] + w[3]) / 2, w[0])):
        middle = (word[1] + word[3]) / 2
        if lines and low <= middle <= high:
            lines[-1].append(word)
            low, high = min(low, word[1]), max(high, word[3])
        else:
            lines.append([word])
            low, high = word[1], word[3]
    return [sorted(line) for line in lines]


def cells(line: list[Word], gap: float) -> list[Word]:
    """The words of a line joined where they stand closer than the gap."""
    out: list[Word] = []
    for x0, top, x1, bottom, text in line:
        if out and x0 - out[-1][2] < gap:
            last = out[-1]
            out[-1] = (last[0], min(last[1], top), max(last[2], x1), max(last[3], bottom), f"{last[4]} {text}")
        else:
            out.append((x0, top, x1, bottom, text))
    return out


def columns(rows: list[list[Word]]) -> list[tuple[float, float]]:
    """The intervals that cells cover, joined where they touch, swept from left to right: what is between them is empty in all rows."""
    out: list[tuple[float, float]] = []
    for x0, x1 in sorted((c[0], c[2]) for row in rows for c in row):
        if out and x0 <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x1))
        else:
            out.append((x0, x1))
    return out


def tables_of(words: list[Word]) -> list[tuple[list[list[str]], Word]]:
    """(grid, box) of each run of two or more lines of cells that leave a gap in common.

    A line joins the table above it if it is near and has cells side by side, or one that doesn't reach over a gap, and if
    at least two columns remain with it; so prose before, between and after tables ends them.
    """
    found: list[tuple[list[list[str]], Word]] = []
    rows: list[list[Word]] = []

    def end() -> None:
        while rows and len(rows[-1]) < 2:  # a single cell at the end is a line of its own
            rows.pop()
        if len(rows) >= 2:
            spans = columns(rows)
            grid = [["" for _ in spans] for _ in rows]
            for r, row in enumerate(rows):
                for cell in row:
                    at = next(k for k, (a, b) in enumerate(spans) if a <= cell[0] <= b)
                    grid[r][at] = f"{grid[r][at]} {cell[4]}".strip()
            every = [c for row in rows for c in row]
            found.append((grid, (min(c[0] for c in every), min(c[1] for c in every), max(c[2] for c in every), max(c[3] for c in every), "")))
        rows.clear()

    for line in bands(words):
        height = sorted(w[3] - w[1] for w in line)[len(line) // 2]
        row = cells(line, CELL_GAP * height)
        near = rows and line[0][1] - max(c[3] for c in rows[-1]) <= ROW_GAP * height
        if rows and not (near and len(columns([*rows, row])) >= max(2, len(columns(rows)) - (len(row) > 1))):
            end()
        if rows or len(row) >= 2:
            rows.append(row)
    end()
    return found


def detect(words: DataFrame) -> DataFrame:
    """doc_id, page, grid_pos, grid, page_width, page_height and box for each table found.

    words: doc_id, page, x0, top, x1, bottom, text, page_width, page_height, tops counted downwards. A page's words are
    gathered in one row, and many pages go through Python together. Words without text or box don't count.
    """
    good = words.where("text is not null and x0 is not null and top is not null and x1 is not null and bottom is not null and trim(text) <> ''")
    word = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")], F.col("text").cast("string").alias("text"))
    pages = good.groupBy("doc_id", F.col("page").cast("int").alias("page")).agg(F.collect_list(word).alias("words"), *[F.first(c).cast("double").alias(c) for c in ("page_width", "page_height")])
    fields = [("grid_pos", pa.int32()), ("grid", pa.list_(pa.list_(pa.string()))), ("page_width", pa.float64()), ("page_height", pa.float64()), ("box", pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("page", pa.int32()), *fields])
            listed = batch.column("words")
            ends, every = listed.offsets.to_pylist(), listed.values
            for at in range(0, batch.num_rows, PAGES):
                told = batch.select(["doc_id", "page", "page_width", "page_height"]).slice(at, PAGES).to_pylist()
                rows = []
                for page, a, b in zip(told, ends[at:], ends[at + 1 :]):
                    part = every.slice(a, b - a)
                    found = tables_of(list(zip(*[part.field(c).to_pylist() for c in ("x0", "top", "x1", "bottom", "text")])))
                    rows += [{**page, "grid_pos": k, "grid": grid, "box": dict(zip(("x1", "y1", "x2", "y2"), box))} for k, (grid, box) in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    kind = words.schema["doc_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"doc_id {kind}, page int, grid_pos int, grid array<array<string>>, page_width double, page_height double, box struct<x1:double,y1:double,x2:double,y2:double>")

"""Sections and chunks of documents. Cut points depend on what was cut before, so one Arrow pass per document finds them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import detect_heading_level, make_summary

HEADING = re.compile(r"(#{1,6})\s+(.*)")
#: So many rows, or characters, go back to Spark together.
ROWS, CHARS = 4096, 1 << 22
#: Sentence and paragraph ends where a chunk may be cut, best first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ")
INTRO, WHOLE, PART = "引言", "全文", "{title} (第 {part} 部分)"


def sections_of(text: str, level: int = 3, most: int = 10_000, overlap: int = 200, least: int = 80) -> list[tuple[str, str]]:
    """TX8: (title, text) of a document's sections.

    Only headings of exactly `level` begin one. Shallower headings stay in the running section and only lead the next
    titles. Short sections go; long ones become overlapping slices. With none left the document is one section, as it is.
    """
    out: list[tuple[str, str]] = []
    path: dict[int, str] = {}
    title, body = INTRO, []

    def close() -> None:
        whole = "\n".join(body).strip()
        if len(whole) < least:
            return
        if len(whole) <= most:
            out.append((title, whole))
            return
        step = most - overlap
        out.extend((PART.format(title=title, part=at // step + 1), whole[at : at + most]) for at in range(0, len(whole), step) if whole[at : at + most].strip())

    for line in text.split("\n"):
        m = HEADING.match(line)
        depth = len(m[1]) if m else 0
        if m:
            path = {d: t for d, t in path.items() if d < depth} | {depth: m[2].strip()}
        if depth == level:
            close()
            title, body = " > ".join(path[d] for d in sorted(path)), []
        body.append(line)
    close()
    return out or [(WHOLE, text)]


def _neighbours(text: str) -> list[str]:
    """Blocks under level-4 headings, each with the last third of the block before and the first third of the next."""
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.startswith("#### ") and any(x.strip() for x in blocks[-1]):
            blocks.append([])
        elif line.startswith("#### "):
            blocks[-1] = []
        blocks[-1].append(line)
    blocks = [b for b in blocks if any(x.strip() for x in b)]
    third = lambda b: max(1, len(b) // 3)
    return ["\n".join([*(blocks[i - 1][-third(blocks[i - 1]) :] if i else []), *b, *(blocks[i + 1][: third(blocks[i + 1])] if i + 1 < len(blocks) else [])]) for i, b in enumerate(blocks)]


def _windows(text: str, size: int, overlap: int) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            window = text[at:end]
            for sep in SEPARATORS:
                found = window.rfind(sep)
                if found > 0.4 * size:
                    end = at + found + len(sep)
                    break
        piece = text[at:end].strip()
        if piece:
            yield piece
        at = end - overlap


def chunks_of(text: str, size: int = 500, overlap: int = 50, drop_contained_tail: bool = False) -> list[str]:
    """TX9: chunks of a section: the whole, or its level-4 blocks with their neighbours' edges, or windows."""
    if len(text) <= size:
        return [text] if text else []
    blocks = _neighbours(text)
    if len(blocks) > 1:
        out = [c for b in blocks for c in (_windows(b, size, overlap) if len(b) > size else [b.strip()] if b.strip() else [])]
    else:
        out = list(_windows(text, size, overlap))
    if drop_contained_tail and len(out) > 1 and out[-2].endswith(out[-1]):
        out.pop()
    return out


def index_documents(docs: DataFrame, level: int | None = None, max_section_size: int = 10_000, size: int = 500, overlap: int = 50) -> DataFrame:
    """TX10: (doc_id, section_id, section_title, section_text, chunk_id, chunk): a row for each chunk, in one pass.

    Chunk numbers run through a document. The heading level is found for each document unless given. Null texts are
    empty: one empty section, no chunk.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.lit(level) if level else detect_heading_level(F.col("text"))).alias("level"))

    most, most_chars = ROWS, CHARS
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, section_id int, section_title string, section_text string, chunk_id int, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = "doc_id", "section_id", "section_title", "section_text", "chunk_id", "chunk"
            types = dict(zip(names, (b.schema.field("doc_id").type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True))
            pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=names)  # noqa: B023, E731
            out, chars = [], 0
            for doc_id, text, lv in zip(b["doc_id"], b["text"], b["level"], strict=True):
                doc_id, text, n = doc_id.as_py(), text.as_py(), 0
                for s, (title, body) in enumerate(sections_of(text, lv.as_py(), max_section_size)):
                    pieces = chunks_of(body, size, overlap)
                    out += [(doc_id, s, title, body if i == 0 else None, n + i, p) for i, p in enumerate(pieces or [None])]
                    n += len(pieces)
                chars += len(text)
                if len(out) >= most or chars >= most_chars:
                    yield pack(out)
                    out, chars = [], 0
            if out:
                yield pack(out)

    return rows.mapInArrow(run, kind)


def sections(indexed: DataFrame) -> DataFrame:
    """(doc_id, section_id, title, text, summary, chars): the section rows of index_documents' output."""
    s = indexed.where("section_text is not null").select("doc_id", "section_id", F.col("section_title").alias("title"), F.col("section_text").alias("text"))
    return s.withColumns({"summary": make_summary(F.col("text"), F.col("title")), "chars": F.length("text")})


def chunks(indexed: DataFrame, source: str = "") -> DataFrame:
    """(doc_id, chunk_id, section_id, section_title, source, text), titles cut to 200 characters."""
    return indexed.where("chunk is not null").select("doc_id", "chunk_id", "section_id", F.substring("section_title", 1, 200).alias("section_title"), F.lit(source).alias("source"), F.col("chunk").alias("text"))


def pages(docs: DataFrame, size: int = 8000) -> DataFrame:
    """TX11: (doc_id, page, text) of documents without sections, by position."""
    n = F.ceil(F.length("text") / size).cast("int")
    p = docs.where("text <> ''").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    return p.select("doc_id", "page", F.substring("text", F.col("page") * size + 1, F.lit(size)).alias("text"))

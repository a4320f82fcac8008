"""Sections, chunks and their identity. Every operator is map-only, and linear in the length of a document."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.rows import expand_rows
from folioscope.functions.text import SPACES, strip
from folioscope.functions.vocab import CHUNK_OVERLAP, CHUNK_SIZE, CODE_MARKS, TITLE_COMBINE, TITLE_MAX, TITLE_SOFT

SENTENCE_END = re.compile("[.!?]+")

ELEMENT = "array<struct<kind:string,text:string,page:int>>"
HEADING = re.compile(rf"^[{SPACES}]*#+ [{SPACES}]*[^{SPACES}].*[^{SPACES}][{SPACES}]*$")


def sections_of(text: str | None) -> list[tuple[int, str, str]]:
    """(number, kind, text) of paragraphs, code blocks and headings, from one pass over the lines.

    A code block keeps going over blank lines and ends only at a plain line that is indented
    less than the block's first line; a block that opens at the margin therefore never ends.
    """
    found: list[tuple[int, str, str]] = []
    if not text:
        return found
    lines = text.split("\n")
    kind, first, margin = "", 0, 0

    def close(after: int) -> None:
        if kind:
            found.append((len(found), kind, "\n".join(lines[first:after])))

    for at, line in enumerate(lines):
        bare = line.lstrip(SPACES)
        indent, blank, codey = len(line) - len(bare), not bare, any(mark in line for mark in CODE_MARKS)
        if kind == "code":
            if not blank and not codey and indent < margin:
                close(at)
                kind, first = "paragraph", at
        elif codey:
            close(at)
            kind, first, margin = "code", at, indent
        elif HEADING.match(line):
            close(at)
            found.append((len(found), "heading", line))
            kind = ""
        elif blank:
            close(at)
            kind = ""
        elif not kind:
            kind, first = "paragraph", at
    close(len(lines))
    return found


def sectionize(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: section_no, kind (heading/paragraph/code), section_text."""
    return expand_rows(docs, [c for c in docs.columns if c != text], [text], sections_of,
                       "section_no int, kind string, section_text string")


def line_elements(docs: DataFrame, title_max: int = 60, lines_per_page: int = 10) -> DataFrame:
    """Adds ``elements``: non-blank lines, short ones as titles, pages counted in lines (titles carry none)."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(
        F.when(F.length(line) <= title_max, "Title").otherwise("NarrativeText").alias("kind"),
        line.alias("text"),
        F.when(F.length(line) > title_max, (F.floor(i / lines_per_page) + 1).cast("int")).alias("page"),
    ))
    return docs.withColumn("elements", F.filter(lines, lambda e: strip(e["text"]) != "").cast(ELEMENT))


def title_chunks_of(elements: list[dict] | None, own_page: int | None, hard: int, soft: int,
                    combine: int) -> list[tuple[int, str, int | None, str | None]]:
    """(index, text, page, title) of a greedy fill; elements longer than ``hard`` are cut first."""
    found: list[tuple[int, str, int | None, str | None]] = []
    parts: list[str] = []
    page = title = latest = None
    length = 0

    def close() -> None:
        if parts:
            found.append((len(found), "\n\n".join(parts), own_page if page is None else page, title))

    for element in elements or []:
        whole = element["text"] or ""
        for at in range(0, max(1, len(whole)), hard):
            text = whole[at:at + hard]
            is_title = element["kind"] == "Title"
            if is_title:
                latest = text
            if not parts or (is_title and length >= combine) or length >= soft or length + 2 + len(text) > hard:
                close()
                parts, page, title, length = [], None, latest, -2
            parts.append(text)
            length += 2 + len(text)
            if page is None:
                page = element["page"]
    close()
    return found


def title_chunks(docs: DataFrame, hard: int = TITLE_MAX, soft: int = TITLE_SOFT,
                 combine: int = TITLE_COMBINE) -> DataFrame:
    """Groups ``elements`` into chunks under their titles.

    Adds chunk_index, chunk_text, page_number (first page among the parts, else ``own_page`` when the
    input carries one) and section_title (nearest title at or before the chunk's first element).
    """
    keep = [c for c in docs.columns if c not in ("elements", "text", "own_page")]
    own = docs if "own_page" in docs.columns else docs.withColumn("own_page", F.lit(None).cast("int"))
    return expand_rows(own, keep, ["elements", "own_page"],
                       lambda elements, page: title_chunks_of(elements, page, hard, soft, combine),
                       "chunk_index int, chunk_text string, page_number int, section_title string")


def window_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows of ``size`` characters that share ``overlap`` characters with the one before."""
    def windows(text: str | None) -> list[tuple[int, str]]:
        if text is None:
            return []
        return [(i, text[at:at + size]) for i, at in enumerate(range(0, max(1, len(text) - overlap), size - overlap))]

    return expand_rows(docs, [c for c in docs.columns if c != "text"], ["text"], windows, "chunk_index int, chunk_text string")


def sentence_chunks(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Sentences packed by running length; from the second chunk on, each opens with the sentence before it."""
    def packed(text: str | None) -> list[tuple[int, str, int]]:
        parts = [p for p in (s.strip(SPACES) for s in SENTENCE_END.split(text or "")) if p]
        starts, total, bucket = [], 0, -1
        for at, part in enumerate(parts):
            if total // size != bucket:
                bucket = total // size
                starts.append(at)
            total += len(part) + 2
        return [(i, ". ".join(parts[max(a - 1, 0):b]) + ".", b - a) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(parts)]))]

    return expand_rows(docs, [c for c in docs.columns if c != "text"], ["text"], packed,
                       "chunk_index int, chunk_text string, n_sentences int")


def chunk_id(name: Column, index: Column, text: Column) -> Column:
    """``<file>_<index>_<8 hex>``; the hex comes from the text, so that a rerun gives the same id."""
    return F.concat_ws("_", name.cast("string"), index.cast("string"), F.substring(F.md5(text), 1, 8))


def section_path(df: DataFrame, path: str = "path", kind: Column | None = None) -> DataFrame:
    """Adds path_parts, section_title, parent_section and the context label."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return (
        df.withColumn("path_parts", parts)
        .withColumn("section_title", F.coalesce(F.try_element_at("path_parts", F.lit(-1)), F.lit("Uncategorized")))
        .withColumn("parent_section", F.try_element_at("path_parts", F.lit(-2)))
        .withColumn("context_label", F.concat(
            F.array_join("path_parts", " > "), F.lit(" | "),
            F.coalesce(kind if kind is not None else F.lit(None).cast("string"), F.lit("general"))))
    )


def drop_blank(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    return chunks.filter(strip(F.col(text)) != "")

"""HTML pages to typed elements and links. Map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.rows import posexplode_rows
from folioscope.functions.text import squeeze

_NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
#: Tags that begin or end a block; all other tags stand inside one.
BLOCK_TAGS = ("title|h[1-6]|p|li|ul|ol|dl|dt|dd|div|section|article|main|aside|nav|header|footer|body|head|html|table|caption|thead|tbody|tfoot|"
              "tr|td|th|pre|blockquote|figure|figcaption|form|fieldset|address|details|summary|br|hr")
_BLOCK = rf"(?i)<(/?(?:{BLOCK_TAGS}))\b[^>]*>"
_LINK = r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _plain(fragment: Column) -> Column:
    text = F.regexp_replace(fragment, "<[^>]*>", " ")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def _elements(html: Column) -> Column:
    """The text between block tags, typed by the tag before it. No text is lost, however tags are nested or left open."""
    marked = F.regexp_replace(F.regexp_replace(html, _NOISE, " "), _BLOCK, "\u0001$1\u0002")

    def element(piece):
        tag = F.when(piece.contains("\u0002"), F.lower(F.substring_index(piece, "\u0002", 1))).otherwise("")
        return F.struct(
            F.when(tag.rlike("^(?:title|h[1-6])$"), "Title").when(tag == "li", "ListItem").otherwise("NarrativeText").alias("kind"),
            _plain(F.substring_index(piece, "\u0002", -1)).alias("text"),
            F.lit(None).cast("int").alias("page"),
        )

    return F.filter(F.transform(F.split(marked, "\u0001", -1), element), lambda e: e["text"] != "")


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the ``elements`` array that the chunkers read; drops the raw page."""
    return pages.withColumn("elements", _elements(F.col(html))).drop(html)


def html_elements(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (Title/NarrativeText/ListItem), text."""
    return posexplode_rows(with_elements(pages), ["page_id"], "elements", "pos", "e").select(
        "page_id", "pos", F.col("e.kind").alias("kind"), F.col("e.text").alias("text"))


def html_links(pages: DataFrame) -> DataFrame:
    links = F.regexp_extract_all(F.regexp_replace("html", _NOISE, " "), F.lit(_LINK), F.lit(1))
    return posexplode_rows(pages, ["page_id"], links, "pos", "href")


def marked_text(pages: DataFrame) -> DataFrame:
    """Pages as text with '# ' headings and blank lines between blocks, ready to be sectioned."""
    line = F.transform("elements", lambda e: F.when(e["kind"] == "Title", F.concat(F.lit("# "), e["text"]))
                       .when(e["kind"] == "ListItem", F.concat(F.lit("- "), e["text"])).otherwise(e["text"]))
    return with_elements(pages).select("page_id", F.array_join(line, "\n\n").alias("text"))

"""Where cited text sits in its document, and merging of the spans found."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions.rows import expand_rows, explode_rows
from folioscope.functions.text import SPACES

_SPACE = re.compile(f"[{SPACES}]+")


def _squeezed(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip(" ")


def _starts(text: str, needle: str) -> list[int]:
    """Start positions of every occurrence, overlapping ones too."""
    found, at = [], text.find(needle)
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + 1)
    return found


def spans_of(document: str | None, needle: str | None) -> list[tuple[int, int, str]]:
    """(start, end, text) of a needle in a document; positions count in the squeezed document."""
    text, needle = _squeezed(document), _squeezed(needle)
    if not text or not needle:
        return []
    exact = [(at, at + len(needle)) for at in _starts(text, needle)]
    lead = needle.split(" ")[:3]
    if not exact and len(lead) == 3:
        for at in _starts(text, " ".join(lead)):
            dot = text.find(".", at)
            exact.append((at, dot if dot >= 0 else min(at + 2 * len(needle), len(text))))
    return [(a, b, text[a:b].strip(" ")) for a, b in exact]


def find_spans(rows: DataFrame, document: str = "text", needle: str = "needle") -> DataFrame:
    """One row per span: start, end, span_text; positions count in the white-space-squeezed document.

    Exact occurrences first. Without any, and from three words on, the first three words are looked
    for and the span runs to the next '.', else twice the needle's length. Linear in the document and its hits.
    """
    return expand_rows(rows, [c for c in rows.columns if c not in (document, needle)], [document, needle], spans_of,
                       "start int, end int, span_text string")


def phrase_scan(docs: DataFrame, key: str, phrases: list[str], text: str = "text") -> DataFrame:
    """key, phrase, n: case-blind hits of a short phrase list, by one alternation over the whole text."""
    pattern = "(?iu)(?:" + "|".join(re.escape(p) for p in phrases) + ")"
    hits = explode_rows(docs, [key], F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), "hit")
    return hits.groupBy(key, F.lower("hit").alias("phrase")).agg(
        F.count(F.lit(1)).alias("n"))


def _beside(rows: DataFrame, per_slice: DataFrame, group: list[str]) -> DataFrame:
    """The rows with the columns of their slice; a null in the group is a value like any other."""
    names = {c: f"_of{i}" for i, c in enumerate([*group, "_slice"])}
    other = per_slice.withColumnsRenamed(names)
    return rows.join(other, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())


def merge_spans(spans: DataFrame, group: list[str], width: int = 65536) -> DataFrame:
    """group, start, end, n_spans: one span per start, intersecting spans joined.

    Work goes by slices of a document. A slice's summary is how far its spans reach; the farthest reach before a slice is its
    carry, and with it the slice's spans are merged on their own. What a slice begins with below its carry goes on an island of an
    earlier slice: the last one that any slice before has opened. Only summaries, a row a slice, meet per document.
    """
    keys = [*group, "_slice"]
    single = spans.groupBy(*group, "start").agg(F.max("end").alias("end")).withColumn("_slice", F.floor(F.col("start") / width))
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = single.groupBy(*keys).agg(F.max("end").alias("_reach")).withColumn("_carry", F.max("_reach").over(earlier)).drop("_reach")
    inside = W.partitionBy(*keys).orderBy("start")
    reach = F.greatest("_carry", F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    opened = _beside(single, carried, group).withColumn("_reach", reach).withColumn(
        "_new", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0))
    numbered = opened.withColumn("_island", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spans"))
    last = parts.groupBy(*keys).agg(F.max("_island").alias("_n"))
    owner = F.last(F.when(F.col("_n") > 0, F.struct(F.col("_slice").alias("s"), F.col("_n").alias("i"))), ignorenulls=True).over(earlier)
    owned = _beside(parts, last.withColumn("_owner", owner).drop("_n"), group)
    own = F.struct(F.col("_slice").alias("s"), F.col("_island").alias("i"))
    return owned.withColumn("_of", F.when(F.col("_island") > 0, own).otherwise(F.col("_owner"))).groupBy(*group, "_of").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_spans").alias("n_spans")).drop("_of")


def highlight_records(hits: DataFrame, layout: DataFrame) -> DataFrame:
    """query_id, chunk_id, page, coords of retrieved chunks that have both."""
    return hits.join(layout, "chunk_id").filter("page is not null and coords is not null").select(
        "query_id", "chunk_id", "page", "coords")

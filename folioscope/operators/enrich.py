"""Chunk enrichment: semantic type, key phrases, keywords, importance, language, term vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType

from folioscope.functions.rows import explode_rows
from folioscope.functions.text import capital_phrases, sentences, strip, tokens, words
from folioscope.functions.vocab import (
    EXAMPLE_WORDS, IMPORTANCE_BY_TYPE, IMPORTANCE_WEIGHTS, INDONESIAN_WORDS, SEMANTIC_TYPES,
    STOP_WORDS, TYPE_MIN_SCORE, TYPE_WEIGHTS, java_pattern,
)
from folioscope.session import cut_lineage, dealt


def _count(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])


def _example_share(text: Column) -> Column:
    parts = F.filter(sentences(text), lambda s: strip(s) != "")
    hit = java_pattern(r"\b(?:" + "|".join(EXAMPLE_WORDS) + r")\b", "i")
    return F.size(F.filter(parts, lambda s: s.rlike(hit))).cast("double") / F.greatest(F.size(parts), F.lit(1))


def _sql(text: str) -> str:
    """A raw SQL string; one parsed expression is far cheaper to build than hundreds of Column objects."""
    return f'r"{text}"'


def _type_score(text: str, name: str, patterns: list[str], keywords: list[str], indicators: list[str]) -> str:
    share = lambda tests: f"({' + '.join(f'int({t})' for t in tests)}) / {len(tests)}D"
    parts = [
        (share([f"rlike({text}, {_sql(java_pattern(p, 'im'))})" for p in patterns]), "pattern"),
        (share([f"contains(lower({text}), {_sql(k)})" for k in keywords]), "keyword"),
        (share([f"contains(lower({text}), {_sql(i)})" for i in indicators]), "indicator"),
    ]
    if name == "EXAMPLE":
        parts.append(("_example", "linguistic"))
    weigh = lambda some: " + ".join(f"{p} * {TYPE_WEIGHTS[w]}D" for p, w in some)
    # all patterns together add at most their weight: below that distance from the minimum they cannot matter
    need = TYPE_MIN_SCORE - TYPE_WEIGHTS["pattern"] - 1e-6
    return f"IF({weigh(parts[1:])} >= {need:.6f}D, {weigh(parts)}, 0D)"


def semantic_type(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Adds semantic_type and type_score: the best scoring type at or above the minimum, else GENERAL."""
    names = [name for name, *_ in SEMANTIC_TYPES]
    scores = ", ".join(_type_score(f"`{text}`", *row) for row in SEMANTIC_TYPES)
    best = F.array_max("_scores")
    return (
        df.withColumn("_example", _example_share(F.col(text)))
        .withColumn("_scores", F.expr(f"array({scores})"))
        .withColumn("semantic_type", F.when(best >= TYPE_MIN_SCORE, F.element_at(
            F.array(*[F.lit(n) for n in names]), F.array_position("_scores", best).cast("int"))).otherwise("GENERAL"))
        .withColumn("type_score", F.when(best >= TYPE_MIN_SCORE, best).otherwise(F.lit(1.0)))
        .drop("_scores", "_example")
    )


#: How many of the most frequent terms are sent to every task; rarer ones meet their rows by shuffle.
COMMON_TERMS = 200_000


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf. The texts move once, to the task of their key; their tokens, far larger, do not."""
    return (
        explode_rows(dealt(df.select(key, text), key, text), [key], tokens(F.col(text)), "term")
        .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def vectorize(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors of a text column: key, term, w."""
    return unit_vectors(term_counts(df, key, text), key, df.agg(F.count(F.lit(1)).alias("n")))


def vocabulary(counts: DataFrame) -> DataFrame:
    """term, df — written out, since it is read several times."""
    return cut_lineage(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def by_frequency(per_term: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the most frequent terms, ``COMMON_TERMS`` at most, the rarer ones or None if there are none) of term, df."""
    seen, least, rest = 0, None, False
    for r in sorted(per_term.groupBy("df").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # the frequencies that occur
        seen, rest = seen + r["n"], seen + r["n"] > COMMON_TERMS
        if rest:
            break
        least = r["df"]
    if not rest:
        return per_term, None
    if least is None:
        return per_term.filter(F.lit(False)), per_term
    return per_term.filter(F.col("df") >= least), per_term.filter(F.col("df") < least)


def with_frequency(rows: DataFrame, key: str, per_term: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` plus df (null for a term that ``per_term``: term, df, does not hold).

    The most frequent terms are most of the rows; they are broadcast, ``COMMON_TERMS`` at most. The rows of the other terms are
    looked up by shuffle and come back as one map per key, so rows that lie by ``key`` stay where they are.
    """
    common, rarer = by_frequency(per_term.select(F.col("term").alias(term), "df"))
    known = rows.join(F.broadcast(common), term, "left")  # bounded
    if rarer is None:
        return known
    rare = rows.select(key, term).distinct().join(F.broadcast(common.select(term)), term, "left_anti").join(rarer, term)
    per_key = rare.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(term, "df"))).alias("_rare"))  # terms of one key
    found = known.join(per_key.hint("shuffle_hash"), key, "left")
    return found.withColumn("df", F.coalesce("df", F.try_element_at("_rare", F.col(term)))).drop("_rare")


def unit_vectors(counts: DataFrame, key: str, total: DataFrame) -> DataFrame:
    """key, term, w from key, term, tf with w ∝ tf · (ln((1+N)/(1+df)) + 1). ``total``: one row, n."""
    weighted = (
        with_frequency(counts.select(key, "term", "tf"), key, vocabulary(counts)).join(F.broadcast(total.select("n")))  # one-row side
        .withColumn("raw", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / norm).alias("w"))


def embed(df: DataFrame, text: str, load_model, batch_size: int = 256, name: str = "embedding") -> DataFrame:
    """Adds dense vectors from a caller's model. ``load_model()`` runs once per Python worker and returns a
    function from an array of texts to a matrix."""
    from pyspark.ml.functions import predict_batch_udf

    vectors = predict_batch_udf(load_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(name, vectors(F.col(text)))


def keywords(df: DataFrame, key: str, text: str, n: int = 10, n_terms: int = 5, min_len: int = 4) -> DataFrame:
    """key, keywords: capitalised phrases plus the top tf-idf terms, the ``n`` longest kept.

    Terms and phrases leave the text in one pass, marked apart. The texts move once, to the task of their key, where terms are
    counted and a key's rows become one: its longest phrases, its best frequent terms, and its rarer terms. Only the rarer terms
    are looked up by shuffle; phrases have no frequency and take no part in it.
    """
    tagged = lambda items, phrase: F.transform(items, lambda v: F.struct(F.lit(phrase).alias("phrase"), v.alias("value")))
    both = F.filter(F.concat(tagged(tokens(F.col(text)), False), tagged(capital_phrases(F.col(text)), True)),
                    lambda s: F.length(s["value"]) >= min_len)
    items = dealt(df.select(key, text), key, text).select(key, F.explode_outer(both).alias("i")).select(key, "i.phrase", "i.value")  # keeps bare keys
    counts = items.groupBy(key, "phrase", "value").agg(F.count(F.lit(1)).alias("tf"))
    once = F.array_distinct(F.filter(tokens(F.col(text)), lambda t: F.length(t) >= min_len))
    common, rarer = by_frequency(vocabulary(explode_rows(df, [], once, "term")).withColumnRenamed("term", "value"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("n")))  # one-row side
    ranked = F.struct((-F.round(F.col("tf") * F.log(F.col("n") / F.col("df").cast("double")), 6)).alias("l"), F.col("value").alias("v"))
    best = lambda items: F.slice(F.array_sort(items), 1, n_terms)
    longest = lambda items: F.transform(F.slice(F.array_sort(F.transform(
        items, lambda p: F.struct((-F.length(p)).alias("l"), p.alias("v")))), 1, n), lambda s: s["v"])
    # the terms and phrases of one key; phrases beyond its ``n`` longest cannot be among the ``n`` longest of both
    held = counts.join(F.broadcast(common), "value", "left").join(total).groupBy(key).agg(
        longest(F.collect_list(F.when(F.col("phrase"), F.col("value")))).alias("phrases"),
        best(F.collect_list(F.when(~F.col("phrase") & F.col("df").isNotNull(), ranked))).alias("terms"),
        F.collect_list(F.when(~F.col("phrase") & F.col("df").isNull(), F.struct("value", "tf"))).alias("open"))
    if rarer is not None:
        held = cut_lineage(held)
        found = held.select(key, F.explode("open").alias("o")).select(key, "o.value", "o.tf").join(rarer, "value").join(total)
        held = held.select(key, "phrases", "terms").unionByName(
            found.select(key, F.array().cast("array<string>").alias("phrases"), F.array(ranked).alias("terms"))).groupBy(key).agg(
            F.flatten(F.collect_list("phrases")).alias("phrases"), best(F.flatten(F.collect_list("terms"))).alias("terms"))
    return held.select(key, longest(F.array_union("phrases", F.transform("terms", lambda s: s["v"]))).alias("keywords"))


def importance(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """Adds ref_count and importance from reference edges (src, dst), chunk_index and semantic_type."""
    degree = (
        references.select(F.explode(F.array("src", "dst")).alias("chunk_id"))
        .groupBy("chunk_id").agg(F.count(F.lit(1)).alias("ref_count"))
    )
    kind = F.lower("semantic_type")
    weight = reduce(lambda acc, kv: acc.when(kind == kv[0], F.lit(kv[1])), IMPORTANCE_BY_TYPE.items(),
                    F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(IMPORTANCE_BY_TYPE["general"]))
    return (
        chunks.join(degree, "chunk_id", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0)))
        .withColumn("importance",
                    F.lit(IMPORTANCE_WEIGHTS["references"]) * F.least(F.col("ref_count") / F.lit(10.0), F.lit(1.0))
                    + F.lit(IMPORTANCE_WEIGHTS["position"]) * (F.lit(1.0) - F.col("chunk_index") / F.lit(100.0))
                    + F.lit(IMPORTANCE_WEIGHTS["semantic"]) * weight)
    )


def indonesian_hits(text: Column) -> Column:
    """How many of the Indonesian patterns occur."""
    low = F.lower(text)
    return _count([low.rlike(java_pattern(rf"\b{p}\b")) for p in INDONESIAN_WORDS])


def _listed(terms: list[str]) -> Column:
    """How many of ``_tokens`` are in a fixed list."""
    return F.size(F.filter("_tokens", lambda t: t.isin(terms)))


def detect_language(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, lang, confidence, id_hits; map-only, and linear in a text's words.

    Word-pattern rule first, then the stop-word profile with the largest share of hits.
    """
    body = strip(F.coalesce(F.col(text), F.lit("")))
    # measured once, before the lists are matched
    per_row = df.select(
        *keys, indonesian_hits(body).alias("id_hits"), F.size(words(body)).alias("n_words"),
        F.length(body).alias("n_chars"), tokens(body).alias("_tokens"))
    langs = list(STOP_WORDS)
    lists = {lang: sorted(set(ws.split())) for lang, ws in STOP_WORDS.items()}
    per_row = per_row.select(*keys, "id_hits", "n_words", "n_chars", *[_listed(lists[lang]).alias(f"_{lang}") for lang in langs])
    hits = F.array(*[F.col(f"_{lang}") for lang in langs])
    total = reduce(lambda a, b: a + b, [F.col(f"_{lang}") for lang in langs])
    guess = F.when(total > 0, F.element_at(F.array(*[F.lit(x) for x in langs]),
                                           F.array_position(hits, F.array_max(hits)).cast("int"))).otherwise("en")
    conf = F.when(total > 0, F.array_max(hits) / total.cast("double")).otherwise(F.lit(0.0))
    strong = (F.col("id_hits") >= 2) & (F.col("n_words") > 3)
    corrected = (F.col("guess") == "en") & (F.col("conf") < 0.8) & (F.col("id_hits") > 0)
    short = F.col("n_chars") < 5
    return per_row.withColumn("guess", guess).withColumn("conf", conf).select(
        *keys,
        F.when(short, "en").when(strong, "id").when(corrected, "id").otherwise(F.col("guess")).alias("lang"),
        F.when(short, F.lit(0.0)).when(strong, F.lit(0.9))
        .when(corrected, F.lit(0.7) + F.col("id_hits") / (F.col("n_words") * 2.0))
        .otherwise(F.col("conf")).alias("confidence"),
        "id_hits",
    )


def main_language(detected: DataFrame, scope: str, order: str) -> DataFrame:
    """scope, main_lang from detect_language rows that carry ``scope`` and an ``order`` column.

    Two pattern hits count as Indonesian; other rows count when their confidence is above one half.
    """
    voted = detected.withColumn("vote", F.when(F.col("id_hits") >= 2, "id").when(F.col("confidence") > 0.5, F.col("lang")))
    counts = voted.groupBy(scope, "vote").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = W.partitionBy(scope).orderBy(F.col("vote").isNull(), F.desc("n"), "first")
    return (
        counts.withColumn("rn", F.row_number().over(rank)).filter("rn = 1")
        .select(scope, F.coalesce("vote", F.lit("en")).alias("main_lang"))
    )


def route_query_language(queries: DataFrame, keys: list[str], text: str, scope: str, scope_lang: DataFrame) -> DataFrame:
    """keys, query_lang, scope language and whether the question needs translation."""
    found = detect_language(queries, [*keys, scope], text)
    return found.join(scope_lang, scope, "left").select(
        *keys, scope, F.col("lang").alias("query_lang"), F.coalesce("main_lang", F.lit("en")).alias("chunk_lang"),
        (F.col("lang") != F.coalesce("main_lang", F.lit("en"))).alias("needs_translation"))

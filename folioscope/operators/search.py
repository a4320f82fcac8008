"""Keyword and vector indexes, top-k search, fusion and reranking, for many questions at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions.rows import explode_rows
from folioscope.functions.text import tokens
from folioscope.functions.vocab import RERANK_GAP, RERANK_WEIGHTS
from folioscope.operators.windows import top_k
from folioscope.session import cut_lineage, dealt

# No broadcast hints below: Spark broadcasts a side when its measured size is under the threshold
# and shuffles (with skew splitting) when it is not.


def bm25_index(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Postings chunk_id, term, tf, dl.

    The chunks are hash-partitioned by id once; counting terms, scoring and the first top-k step then
    need no further shuffle.
    """
    placed = dealt(chunks.select("chunk_id", text), "chunk_id", text).select("chunk_id", tokens(F.col(text)).alias("_t"))
    return (
        explode_rows(placed, ["chunk_id", F.size("_t").alias("dl")], "_t", "term")
        .groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_stats(postings: DataFrame) -> DataFrame:
    """One row: n chunks with a token, avgdl."""
    sizes = postings.groupBy("chunk_id").agg(F.max("dl").alias("dl"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term — the distinct tokens of each question."""
    return explode_rows(queries, ["query_id"], F.array_distinct(tokens(F.col("text"))), "term")


def _weight_blocks(weights: DataFrame, limit: int, most_queries: int = 1000):
    """(query ids, rows) of query_id, term, weight in driver-sized blocks of about ``limit`` rows.

    Both rows and questions are bounded, and with them the term × question array each task holds.
    """
    held = cut_lineage(weights)
    size = held.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("query_id").alias("ids")).first()
    blocks = max(1, math.ceil(size["rows"] / limit), math.ceil(size["ids"] / most_queries))
    for b in range(blocks):
        part = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()  # bounded by the block size
        if rows:
            yield sorted({r["query_id"] for r in rows}), rows


def score_terms(postings: DataFrame, weights: DataFrame, k: int | None = None, threshold: float | None = None,
                block: int = 20_000) -> DataFrame:
    """query_id, chunk_id, score = Σ impact · weight over shared terms.

    ``postings``: chunk_id, term, impact; ``weights``: query_id, term, weight. Either the best ``k`` per
    question and task (ties by chunk_id) or every score from ``threshold`` on. The terms of a chunk are scored
    against a block of questions as one array product, so the questions × chunks table is never built and
    frequent words cost no more than a multiplication.
    """
    spark = postings.sparkSession
    types = dict(weights.dtypes)["query_id"], dict(postings.dtypes)["chunk_id"]
    schema = f"query_id {types[0]}, chunk_id {types[1]}, score double"
    out = spark.createDataFrame([], schema)
    for ids, rows in _weight_blocks(weights, block):
        terms = sorted({r["term"] for r in rows})
        at, where = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
        cells = [(at[r["term"]], where[r["query_id"]], r["weight"]) for r in rows]

        def scan(batches, ids=ids, n_terms=len(terms), cells=cells):
            import numpy as np
            import pandas as pd

            w = np.zeros((n_terms, len(ids)))
            for i, j, x in cells:
                w[i, j] = x
            best: list = [[] for _ in ids]
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values("chunk_id", kind="stable")
                step = max(1, 4_000_000 // (len(ids) * 64))
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    sizes = part["idx"].str.len().to_numpy()
                    idx, impact = np.concatenate(part["idx"].to_numpy()), np.concatenate(part["impact"].to_numpy())
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    score = np.round(np.add.reduceat(w[idx] * impact[:, None], starts, axis=0), 6)
                    names = part["chunk_id"].to_numpy()
                    if threshold is not None:
                        r, c = np.nonzero(score >= threshold)
                        yield pd.DataFrame({"query_id": [ids[j] for j in c], "chunk_id": names[r], "score": score[r, c]})
                        continue
                    for j in range(len(ids)):
                        full = len(best[j]) == k
                        floor = -best[j][-1][0] if full else 0.0
                        near = np.nonzero((score[:, j] >= floor) & (score[:, j] > 0))[0]
                        if len(near):
                            near = near[np.argsort(-score[near, j], kind="stable")[:k]]
                            best[j] = sorted(best[j] + [(-score[i, j], names[i]) for i in near])[:k]
            if threshold is None:
                flat = [(ids[j], n, -s) for j in range(len(ids)) for s, n in best[j]]
                yield pd.DataFrame(flat, columns=["query_id", "chunk_id", "score"])

        codes = spark.createDataFrame([(t, i) for t, i in at.items()], "term string, idx int")
        packed = (
            postings.join(F.broadcast(codes), "term")  # at most one block of question terms
            .groupBy("chunk_id").agg(F.collect_list(F.struct("idx", "impact")).alias("p"))  # the terms of one chunk
            .select("chunk_id", F.transform("p", lambda x: x["idx"]).alias("idx"),
                    F.transform("p", lambda x: x["impact"].cast("double")).alias("impact"))
        )
        out = out.unionByName(packed.mapInPandas(scan, schema))
    return out


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def bm25_weights(postings: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, term, weight = idf of each question term that occurs in the corpus."""
    terms = query_terms(queries)
    df = document_frequency(postings.join(terms.select("term").distinct(), "term", "left_semi"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(df, "term").join(F.broadcast(stats)).select("query_id", "term", idf.alias("weight"))  # one-row side


def bm25_search(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2,
                b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank."""
    tf, length = F.col("tf"), F.col("dl") / F.col("avgdl")
    impact = postings.join(F.broadcast(stats)).select(  # one-row side
        "chunk_id", "term", ((tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length))).alias("impact"))
    return _ranked(score_terms(impact, bm25_weights(postings, stats, queries), k), k)


def query_vectors(queries: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Unit tf-idf vectors of the questions, weighted with the corpus frequencies: query_id, term, qw."""
    tf = explode_rows(queries, ["query_id"], tokens(F.col("text")), "term").groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    df = document_frequency(postings.join(tf.select("term").distinct(), "term", "left_semi"))
    raw = tf.join(df, "term", "left").join(F.broadcast(stats)).select(  # one-row side
        "query_id", "term",
        (F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("query_id")))
    return raw.select("query_id", "term", (F.col("raw") / norm).alias("qw"))


def cosine_search(vectors: DataFrame, query_vecs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, rank over unit term vectors."""
    return _ranked(score_terms(vectors.withColumnRenamed("w", "impact"), query_vecs.withColumnRenamed("qw", "weight"), k), k)


def cosine_above(vectors: DataFrame, query_vecs: DataFrame, threshold: float) -> DataFrame:
    """query_id, chunk_id, score of every chunk at or above the threshold."""
    return score_terms(vectors.withColumnRenamed("w", "impact"), query_vecs.withColumnRenamed("qw", "weight"),
                       threshold=threshold)


def reciprocal_rank_fusion(dense: DataFrame, keyword: DataFrame, top: int = 10, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank from two ranked lists; score = Σ 1/(rrf_k + rank)."""
    a = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    b = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "chunk_id"], "full").withColumn(
        "score", F.round(part("dense_rank") + part("keyword_rank"), 6))
    return top_k(fused, ["query_id"], [F.desc("score"), F.col("chunk_id")], top)


def threshold_and_caps(hits: DataFrame, threshold=0.75, per_doc=3, total=10) -> DataFrame:
    """Score at or above the threshold, then at most ``per_doc`` per document, then ``total`` per question.

    The limits may be numbers or columns of ``hits`` (settings of the question's group).
    """
    order = [F.desc("score"), F.col("chunk_id")]
    good = hits.filter(F.col("score") >= threshold)
    capped = top_k(good, ["query_id", "doc_id"], order, per_doc, "doc_rank")
    return top_k(capped, ["query_id"], order, total, "rank")


def rerank(scored: DataFrame, max_total: int = 10) -> DataFrame:
    """query_id, chunk_id, final_score, rank: best chunk, or the two best when they are close.

    ``scored``: query_id, chunk_id, llm, initial.
    """
    final = F.lit(RERANK_WEIGHTS["llm"]) * F.col("llm") + F.lit(RERANK_WEIGHTS["initial"]) * F.col("initial")
    first_two = top_k(scored.withColumn("final_score", final), ["query_id"],
                      [F.desc("final_score"), F.col("chunk_id")], 2)
    best = F.max("final_score").over(W.partitionBy("query_id"))
    close = (best - F.col("final_score")) <= RERANK_GAP
    return first_two.withColumn("_close", close).filter(
        (F.col("rank") == 1) | (F.col("_close") & F.lit(max_total >= 2))).drop("_close")


def _query_blocks(queries: DataFrame, limit: int):
    """Question vectors in driver-sized blocks of about ``limit`` rows, as (ids, vectors)."""
    blocks = max(1, math.ceil(queries.count() / limit))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.select("query_id", "embedding").collect()  # bounded by the block size
        if rows:
            yield [r[0] for r in rows], [list(r[1]) for r in rows]


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    id_type = dict(vectors.dtypes)["vec_id"]
    q_type = dict(queries.dtypes)["query_id"]
    results = []
    for ids, vecs in _query_blocks(queries, block):
        def scan(batches, ids=ids, vecs=vecs):
            import numpy as np
            import pandas as pd

            q = np.asarray(vecs, dtype=np.float64)
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            best: list = [None] * len(ids)  # scores and ids, of the ids' own type
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                some = norm[:, 0] > 0  # a zero vector is near to nothing
                v, vid = v[some] / norm[some], np.array(pdf["vec_id"].tolist())[some]
                if not len(v):
                    continue
                sims = np.round(q @ v.T, 6)
                for i in range(len(ids)):
                    s, n = sims[i], vid
                    if best[i] is not None:
                        s, n = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], n])
                    keep = np.lexsort((n, -s))[:k]
                    best[i] = (s[keep], n[keep])
            out = [(ids[i], n.item(), float(s)) for i in range(len(ids)) if best[i] is not None and q[i].any() for s, n in zip(*best[i])]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        results.append(vectors.select("vec_id", "embedding").mapInPandas(
            scan, f"query_id {q_type}, vec_id {id_type}, score double"))
    if not results:
        return vectors.sparkSession.createDataFrame([], f"query_id {q_type}, vec_id {id_type}, score double, rank int")
    partial = results[0]
    for more in results[1:]:
        partial = partial.unionByName(more)
    return top_k(partial, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, vec_id, score (cosine), rank — exact.

    Each pass scans the vectors once against a bounded block of questions as an Arrow matrix product and
    keeps k rows per question and partition; only those are shuffled.
    """
    return _nearest(vectors, queries, k, block)


def question_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """query_id, embedding: the mean vector of each group (combined per dimension before the shuffle)."""
    dims = vectors.select(group, F.posexplode("embedding").alias("d", "x"))
    mean = dims.groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(F.col(group).cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("embedding"))

"""Ranked search in an inverted index of terms, and token filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the postings of every term."""
    words = docs.select(key, tokens(F.col(text)).alias("w")).withColumn("length", F.size("w").cast("long"))
    return words.select(key, "length", F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """(key, score) of the documents that hold a term of the query.

    Only the query's terms are counted: the filter is applied to the words before they are grouped, and
    the corpus figures are one row.
    """
    words = docs.select(key, tokens(F.col(text)).alias("w")).withColumn("length", F.size("w").cast("long"))
    corpus = words.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = words.select(key, "length", F.explode(F.filter("w", lambda t: t.isin(query))).alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "term").join(F.broadcast(corpus))  # at most a row for each query term, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy(key).agg(F.sum(part).alias("score"))


LONGEST, LEAST, MOST = 64, 2, 5  # letters of a query, of a word, and words read of a query


def query_words(raw: str | None, longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> list[str]:
    """The words of what a user typed: lower-case letters and digits, single digits too, no other single letters."""
    import re

    words = re.split(r"[^a-z0-9]+", (raw or "")[:longest].lower())
    return [w for w in words if len(w) >= least or (len(w) == 1 and w.isdigit())][:most]


def match_all(docs: DataFrame, key: str, weights: dict[str, float], words: list[str]) -> DataFrame:
    """(key, score) of the documents that hold every word in any of their columns, the last one as a prefix.

    A word's frequency is the sum of its counts by column, each times the column's weight; the rest is BM25
    over all columns' words. Only the query's words leave the scan, before anything is grouped. A word that
    most documents hold still adds a little.
    """
    if any(not w.isascii() or not w.isalnum() or w != w.lower() for w in words):
        raise ValueError("words are lower-case letters and digits, as query_words gives them")
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    text = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in weights}
    # a word stands between other characters; the last may go on
    found = [rf"(?<![a-z0-9]){w}" + ("" if i == len(words) - 1 else "(?![a-z0-9])") for i, w in enumerate(words)]
    size = sum((F.regexp_count(t, F.lit("[a-z0-9]+")) for t in text.values()), F.lit(0)).cast("double")
    counts = [sum((F.regexp_count(t, F.lit(p)) * weights[c] for c, t in text.items()), F.lit(0.0)) for p in found]
    counted = docs.select(key, size.alias("_size"), *[c.alias(f"_f{i}") for i, c in enumerate(counts)])
    figures = counted.agg(F.count("*").alias("_docs"), F.avg("_size").alias("_mean"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_n{i}") for i in range(len(words))])
    every = counted.filter(" AND ".join(f"_f{i} > 0" for i in range(len(words)))).join(F.broadcast(figures))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.log((F.col("_docs") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_size") / F.col("_mean")))
    return every.select(key, score.alias("score"))

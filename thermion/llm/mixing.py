"""Mixing sources to target weights without sorting.

Each document gets a 48-bit hash of its id. A source takes whole repeats of all its documents, and
for what is left of its target those documents whose hash lies below a threshold. The threshold is
found by nested histograms: sizes are summed by source and the hash's top 12 bits, the bucket in
which the running sum passes the budget is refined by the next 12 bits, and so on, until the bucket
is one hash value; only rows of the boundary bucket take part in a refinement. The final selection
is a filter on source and hash, a projection over the documents.

Skew: sums are pre-aggregated before the shuffle, at most 4096 histogram rows a source and level
meet in one task, and the table of sources (a row each) is the only thing joined to the documents.
Spark broadcasts it while it is small and splits skewed partitions otherwise.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows
with the same id (or a null id) share a hash and are taken together; documents without words are taken
in whole repeats of their source only, never more than max_repeat times; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, word_count, written

LEVELS, BITS = 4, 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target, repeats, rest): shares of all words by weight, never above max_repeat times a source's size.

    Water-filling in closed form: in order of cap / weight, a source is capped if its cap is at most
    its share of what the sources before it leave. One row per source, so the windows are small.
    """
    every, by_name = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    share = lambda w, left, of: w * left / of
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps_before", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weights_on", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("capped", F.col("cap") <= share(F.col("weight"), F.col("total") - F.col("caps_before"), F.col("weights_on")))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("of", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share(F.col("weight"), F.col("left"), F.col("of"))))
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
        .select("source", "source_size", "target", "repeats", "rest")
    )


def id_hash(doc_id: Column) -> Column:
    """48 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def _thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, limit, at_limit): take hashes below limit, and those equal to it if at_limit."""
    found = written(targets.select(F.col("source").alias("of"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), "level-0")
    running = W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        inside = sizes.filter("size > 0").join(found, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright(F.col("hash"), shift + BITS) == F.col("prefix")))
        histogram = inside.groupBy("of", "rest", "before", F.shiftright(F.col("hash"), shift).alias("bucket")).agg(F.sum("size").alias("words"))
        ends = histogram.withColumn("end", F.col("before") + F.sum("words").over(running)).withColumn("before", F.col("end") - F.col("words"))
        passed = ends.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("end")))
        found = written(passed.select("of", "rest", F.col("bucket").alias("prefix"), "before", "end"), f"level-{level}")
        last, found = found, found.drop("end")
    nearer = F.col("end") - F.col("rest") < F.col("rest") - F.col("before")
    return last.select(F.col("of").alias("source"), F.col("prefix").alias("limit"), nearer.alias("at_limit"))


def _decided(docs: DataFrame, weights: tuple[int, ...], max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """(sizes, of_source): doc_id, source, size and hash of every row; and what each source takes, a row a source."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "sizes")
    targets = source_targets(sizes, weights, max_repeat)
    limits = _thresholds(sizes, targets)
    joined = targets.alias("t").join(limits.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    return sizes, written(joined.select(F.col("t.source").alias("of"), "source_size", "target", "repeats", "limit", "at_limit"), "targets")


def _times(size: Column, hash_: Column) -> Column:
    """How often a document is taken; one without words is in no threshold's count, so only whole repeats take it."""
    extra = F.coalesce((hash_ < F.col("limit")) | (F.col("at_limit") & (hash_ == F.col("limit"))), F.lit(False))
    return F.col("repeats") + (extra & (size > 0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(doc_id, source, size, hash, source_size, target, times, taken) for every row of docs (doc_id, text, source)."""
    sizes, of_source = _decided(docs, weights, max_repeat)
    times = _times(F.col("size"), F.col("hash"))
    return sizes.join(of_source, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "hash", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """docs as the mix takes them: each row as often as its times says, rows with none dropped; docs' columns. Texts meet a row a source, and are filtered where they are."""
    _, of_source = _decided(docs, weights, max_repeat)
    has_words = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False)).cast("int")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), id_hash(F.col("doc_id")).alias("hash"), F.col("source").alias("of_source"))
    joined = keyed.join(of_source, F.col("of_source").eqNullSafe(F.col("of"))).withColumn("times", _times(has_words, F.col("hash"))).filter("times > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12) AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
filled AS (
  SELECT *, (sum(cap) OVER up)::BIGINT - cap AS caps_before, (sum(weight) OVER down)::BIGINT AS weights_on FROM weighed
  WINDOW up AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING),
         down AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
capping AS (SELECT *, cap <= weight * (total - caps_before) / weights_on AS capped FROM filled),
rest AS (
  SELECT *, total - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS remaining,
         (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::BIGINT AS of_weight FROM capping),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * remaining / of_weight END AS target FROM rest),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM targets),
ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.repeats, p.target - p.repeats * p.source_size AS left_over, s.source, s.h,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING))::BIGINT AS cum_end,
         (sum(s.size) OVER (PARTITION BY s.source, s.h))::BIGINT AS tied
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (repeats + CASE WHEN cum_end <= left_over THEN 1
                              WHEN cum_end - tied <= left_over AND cum_end - left_over < left_over - (cum_end - tied) THEN 1
                              ELSE 0 END)::BIGINT AS taken
FROM ranked
"""

"""Personal data: patterns, and terms that give protected entities away.

Base spans are matches of four patterns (email, ip, card, phone), checked and placed by code points
with built-in functions alone: matches, and the lengths of what lies between them.

Terms are found by information theory. An entity is a value of a base span. From windows of WINDOW
code points around entities, n(t, e) counts the different windows of e that hold term t; n(t) counts
the different texts of the whole corpus that hold t, n(e) those that hold e. The point-wise mutual
information log(N n(t, e) / (n(t) n(e))) as a share of the entity's information content
log(N / n(e)) says how much of the entity t discloses. Terms seen with e in SUPPORT different windows
or more that disclose DISCLOSURE of it or more are generalised wherever they stand in texts that hold e.
Common words never reach that share, and are left out before the corpus is counted: a term that stands
whole in windows of so many texts that no count of the corpus could let it pass is no candidate.

Defined results: null text is empty; repeated rows and equal ids are rows of their own; an entity seen
once discloses nothing; term spans that overlap base spans are dropped; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

WINDOW, SUPPORT, DISCLOSURE = 100, 3, 0.8
KINDS = ("email", "ip", "card", "phone", "term")

# Each pattern finds what the plain one finds, but starts only where a match can: at the beginning of
# a run of its letters, or where the last match ended (\G). That keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{M}'-]{2,}+"
#: What a text must hold to be searched at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Checksum of up to 19 digits."""
    place = lambda d, i: F.substring(d, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = let(F.reverse(_digits(value)), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(place(d, i))).otherwise(place(d, i))))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: Column, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of all matches: places add up the lengths of matches and of what is between them."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)").alias("out"))

        def add(state: Column, i: Column, g: Column) -> Column:
            start = state["at"] + g[i]
            end = start + F.length(found[i])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), found[i].alias("value")))).alias("out"))

        return let(gaps, lambda g: F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, lambda s, i: add(s, i, g))["out"])

    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    return let(F.regexp_extract_all(text, pattern, 0), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def of_kind(i: int, kind: str, pattern: str) -> Column:
        kept = F.filter(_matches(text, F.lit(pattern), i), lambda s: _valid(kind, s["value"]))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), kept).otherwise(none) if NEEDS[kind] else kept

    return F.array_sort(F.concat(*[of_kind(i, kind, pattern) for i, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False))]))


def spelled(spans: Column) -> Column:
    name = lambda k: F.element_at(F.lit(list(KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))


def disclosing_terms(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(holders, pairs) for docs (doc_id, text not null): holders (doc_id, text_hash, entity), and pairs (entity, term, share) of terms that disclose an entity."""
    spans = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    one = spans.withColumn("held", terms_of(F.col("text"))).withColumn("s", F.explode("spans"))
    left = F.substring("text", F.greatest(F.col("s.start") - window, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(window)))
    right = F.substring("text", F.col("s.end") + 1, F.lit(window))
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value"))
    around = F.concat_ws(" | ", left, right)
    # a window may cut a word: only terms that the text holds whole count as its own
    whole = F.array_intersect(terms_of(around), F.col("held"))
    seen = written(one.select("doc_id", "text_hash", entity.alias("entity"), around.alias("around"), whole.alias("whole")), "entities")
    holders = seen.select("doc_id", "text_hash", "entity").distinct()

    texts = docs.select(F.xxhash64("text").alias("h")).distinct().count()  # a hash a text
    of_entity = seen.groupBy("entity").agg(F.countDistinct("text_hash").alias("n_e")).filter(F.col("n_e") >= 2)
    content = F.log(F.lit(float(max(texts, 2))) / F.col("n_e"))
    # share >= disclosure  <=>  n(t, e) / n(t) >= exp(-(1 - disclosure) * content)
    needed = F.exp(-(1 - disclosure) * content)
    windows = seen.select("entity", F.xxhash64("around").alias("w"), F.explode(terms_of(F.col("around"))).alias("term")).distinct()
    met = windows.groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support)
    common = seen.select("text_hash", F.explode("whole").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_w"))
    # n_w counts texts that hold the term, never more than n_t: what falls below the bound by n_w falls below it by n_t
    hopeful = met.join(of_entity, "entity").join(common, "term", "left").filter(F.col("n_te") >= F.coalesce("n_w", F.lit(0)) * needed * (1 - 1e-9))
    candidates = written(hopeful.select("entity", "term", "n_te", "n_e"), "candidates")
    wanted = written(candidates.select("term").distinct(), "wanted")
    if wanted.isEmpty():
        return holders, candidates.select("entity", "term", F.lit(0.0).alias("share"))
    in_texts = docs.select(F.xxhash64("text").alias("h"), F.explode(terms_of(F.col("text"))).alias("term")).join(wanted, "term")
    of_term = in_texts.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    likely = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    share = (F.log(likely) + content) / content
    return holders, written(candidates.join(of_term, "term").withColumn("share", share).filter((content > 0) & (F.col("share") >= disclosure)).select("entity", "term", "share"), "pairs")


def found_spans(docs: DataFrame, **how) -> DataFrame:
    """(row, text, base, spans) for every row of docs: the row as a struct, its text (never null), base spans and all spans, arrays of struct<start, kind, end, value>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    holders, pairs = disclosing_terms(docs.select("doc_id", text.alias("text")), **how)
    per_row = holders.join(pairs, "entity").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    found = written(per_row.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "terms"), "terms")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"))
    if found.isEmpty():
        base = rows.withColumn("base", base_spans(F.col("text")))
        return base.withColumn("spans", F.col("base"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left").withColumn("base", base_spans(F.col("text")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}'-])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{M}'-])"))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.when(F.col("terms").isNotNull(), F.array_sort(F.concat("base", F.filter(_matches(F.col("text"), pattern, 4), clear)))).otherwise(F.col("base"))
    return joined.withColumn("spans", more).select("row", "text", "base", "spans")


def sanitised_text(text: Column, spans: Column) -> Column:
    """text with each span, or union of overlapping spans, replaced by the first's kind."""
    label = lambda k: F.concat(F.lit("["), F.upper(F.element_at(F.lit(list(KINDS)), k + 1)), F.lit("]"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), label(s["kind"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, add, rest)).otherwise(text)


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data and disclosing terms generalised in text; n_chars, if there, is the new length."""
    out = found_spans(docs, **how).withColumn("text", sanitised_text(F.col("text"), F.col("spans")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))

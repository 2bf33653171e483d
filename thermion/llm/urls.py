"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The classifier is trained from a small labelled table (LABELLED, or one of the caller's: `url`,
`block` 0 or 1; at most LABELS rows are used). An n-gram's feature is its hash among DIMENSIONS;
n-grams of the host and of the path are hashed apart, and counts are divided by the square root of
their number. The weights, DIMENSIONS numbers, are a literal of the scoring expression: scoring is
one projection over the pages, without join, shuffle or Python.

Rules: a rule names a host, all of whose subdomains it fits, and the beginning of a path; the longest
rule that fits decides, and the classifier where none does.

Defined results: null urls and urls without "://" have empty host and path and are judged by the
classifier on those (allow); long urls cost time in proportion to their length; repeated rows are
judged like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

DIMENSIONS, GRAMS, LABELS, PENALTY = 2048, (3, 4), 10_000, 0.0002
#: The score from which a url is blocked.
CERTAIN = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict), as the query fixes them.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: The small labelled table, of our own making: what unwanted and ordinary sites are about, and how both are named.
UNWANTED = "casino poker roulette slots jackpot betting bets lotto pills meds viagra steroids adult xxx porn escort cams spam seo backlinks ads popups clicks tracker prize giveaway loans warez torrents phishing".split()  # noqa: SIM905
ORDINARY = "library museum archive university school physics news courier weather river council garden chess cycling sailing choir bakery cooking software database mathematics history train airport harbour hiking birds theatre ceramics painting".split()  # noqa: SIM905
NAMES = ["{}-palace", "my{}", "{}24", "best-{}-online", "{}hub"]
PLACES = "thornley ashwick erlington ostermoor hanwell inglethorpe edensor antrimly realton notherby arendal lythwood elmbach ruhental neudorf montclair beaulieu villanueva riobamba campoalto".split()  # noqa: SIM905
PATHS = ["/", "/index.html", "/about", "/archive/2019?id=3", "/en/list/12", "/de/seite-4#oben", "/fr/page/77/", "/es/pagina/31.html", "/contact?from=menu", ""]
TOPS = ["test", "example", "invalid"]
#: Every name stands in three urls, so that neither class has paths, prefixes or tops of its own.
_SITES = [*((n.format(t), 1) for n in NAMES for t in UNWANTED), *((n.format(t), 0) for n in NAMES for t in ORDINARY), *((p, 0) for p in PLACES)]
#: Every name stands in two urls, so that neither class has paths, prefixes or tops of its own.
LABELLED = [(f"https://{('', 'www.', 'm.', 'blog.')[(i + k) % 4]}{name}.{TOPS[(i + k) % 3]}{PATHS[(3 * i + 7 * k) % 10]}", block) for i, (name, block) in enumerate(_SITES) for k in range(2)] + [("", 0)]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host from the first "://" to "/", "?", "#" or the end, A-Z lower-cased; path from there to "?", "#" or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def features(host: Column, path: Column, dimensions: int = DIMENSIONS) -> Column:
    """Feature numbers (from 1) of all n-grams, repeats included; edges are marked."""

    def grams(kind: int, part: Column, n: int) -> Column:
        letters = F.regexp_extract_all(F.concat(F.lit("^"), part, F.lit("$")), F.lit("(?s)."), 0)
        number = lambda c, i: (F.pmod(F.xxhash64(F.lit(kind), F.slice(c, i + 1, n)), F.lit(dimensions)) + 1).cast("int")
        starts = lambda c: F.slice(c, 1, F.greatest(F.size(c) - n + 1, F.lit(0)))
        return let(letters, lambda c: F.transform(starts(c), lambda x, i: number(c, i)))

    return F.concat(*[grams(kind, part, n) for kind, part in enumerate((host, path)) for n in GRAMS])


def train(spark: SparkSession, labelled: DataFrame | None = None, dimensions: int = DIMENSIONS) -> tuple[float, list[float]]:
    """(intercept, weights) of the logistic regression of `block` on a labelled table's urls."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if labelled is None:
        rows = ", ".join(f"('{url}', {block})" for url, block in LABELLED)
        labelled = spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, block)")
    found = labelled.filter(F.col("block").isin(0, 1)).orderBy(F.xxhash64("url"), "url", "block").limit(LABELS)
    hashed = found.select(F.col("block").cast("double").alias("label"), features(*parts(F.col("url")), dimensions).alias("f"))
    counted = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda d: F.size(F.filter("f", lambda x: x == d)) / F.sqrt(F.greatest(F.size("f"), F.lit(1))))
    rows = hashed.withColumn("features", array_to_vector(counted)).select("label", "features").coalesce(1)
    model = LogisticRegression(maxIter=200, regParam=PENALTY, standardization=False).fit(rows)
    return float(model.intercept), [round(float(w), 6) for w in model.coefficients]


def judge(pages: DataFrame, weights: tuple[float, list[float]], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (with url) and host, path, score (of the classifier), rule and verdict."""
    intercept, w = weights
    host, path = parts(F.col("url"))
    table_ = F.lit(w)
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("_f", features(F.col("host"), F.col("path"), len(w)))
    margin = intercept + F.aggregate("_f", F.lit(0.0), lambda a, i: a + F.element_at(table_, i)) / F.sqrt(F.greatest(F.size("_f"), F.lit(1)))
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    rule = F.lit(None).cast("string") if rule is None else rule
    classed = F.when(F.col("score") >= CERTAIN, "block").otherwise("allow")
    return rows.withColumn("score", 1 / (1 + F.exp(-margin))).withColumn("rule", rule).withColumn("verdict", classed if verdict is None else verdict.otherwise(classed)).drop("_f")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), train(spark)).select("page_id", "host", "path", "rule", "verdict")

"""Tracklogs: text files of one flight each, read into one table of fixes.

Files are read line by line with their path as the key, so a folder of any number of logs is one scan;
what needs a file's other lines (its date, the roll over midnight, times that run backwards) is a
window over the file's lines. The order of lines is that of their byte offsets, kept by the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed layout of a fix record: time, latitude, longitude, validity, pressure and satellite altitude.
FIX = r"^B(\d{2})(\d{2})(\d{2})(\d{2})(\d{5})([NS])(\d{3})(\d{5})([EW])([AV])(-\d{4}|\d{5})(-\d{4}|\d{5})"
DATE = r"^HFDTE(?:DATE:)?\s*(\d{2})(\d{2})(\d{2})"
#: The outer radius of a declared area that stands for none (a fixed value).
NO_LIMIT = 9_999_999
HEADERS = {"PLT": "pilot", "GTY": "glider_type", "GID": "glider_id", "CID": "competition_id", "CCL": "competition_class"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(track_file, line_no, line): whole files split into their lines (a log is a few hundred kB)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("track_file"), "value")
    return files.select("track_file", F.posexplode(F.split("value", r"\r\n|\r|\n"))).select("track_file", F.col("pos").alias("line_no"), F.col("col").alias("line"))


def _degrees(whole: Column, thousandths: Column, side: Column) -> Column:
    value = whole.cast("double") + thousandths.cast("double") / 60_000
    return F.when(side.isin("S", "W"), -value).otherwise(value)


def headers(source: DataFrame) -> DataFrame:
    """(track_file, date, pilot, glider_type, glider_id, competition_id, competition_class): the first of each record."""
    line = F.col("line")
    date = F.regexp_extract(line, DATE, 0) != ""
    part = lambda i: F.regexp_extract(line, DATE, i)
    year = F.when(part(3) >= "70", F.concat(F.lit("19"), part(3))).otherwise(F.concat(F.lit("20"), part(3)))
    day = F.when(date, F.try_to_date(F.concat_ws("-", year, part(2), part(1)), "yyyy-MM-dd"))
    # one match of all kinds, so that a file's lines are read once
    named = lambda code: F.regexp_extract(line, rf"^H[FOP]{code}[^:]*:\s*(.*?)\s*$", 1)
    text = lambda code: F.min_by(F.when(named(code) != "", named(code)), F.when(named(code) != "", F.col("line_no")))
    return source.filter(line.startswith("H")).groupBy("track_file").agg(F.min_by(day, F.when(day.isNotNull(), F.col("line_no"))).alias("date"), *[text(c).alias(n) for c, n in HEADERS.items()])


def fixes(source: DataFrame) -> DataFrame:
    """(track_file, fix_index, time_ms, lat, lon, pressure_alt, gnss_alt, valid) of the well-formed fixes of dated files.

    Hours that fall from 18 or later to 6 or earlier begin the next day, once a file; times do not run
    backwards (_disordered), equal times are kept.
    """
    g = lambda i: F.regexp_extract("line", FIX, i)
    rows = source.filter(F.col("line").rlike(FIX)).select(
        "track_file",
        "line_no",
        g(1).cast("int").alias("hour"),
        (g(1).cast("int") * 3600 + g(2).cast("int") * 60 + g(3).cast("int")).alias("second"),
        _degrees(g(4), g(5), g(6)).alias("lat"),
        _degrees(g(7), g(8), g(9)).alias("lon"),
        (g(10) == "A").alias("valid"),
        g(11).cast("int").alias("pressure_alt"),
        g(12).cast("int").alias("gnss_alt"),
        (g(2).cast("int").between(0, 59) & g(3).cast("int").between(0, 59) & g(1).cast("int").between(0, 23)).alias("sane"),
    )
    sane = rows.filter(F.col("sane") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    w = W.partitionBy("track_file").orderBy("line_no")
    turn = F.coalesce((F.lag("hour").over(w) >= 18) & (F.col("hour") <= 6), F.lit(False)).cast("int")
    turned = sane.withColumn("turn", turn).withColumn("day", F.least(F.sum("turn").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1)))
    dated = turned.join(headers(source).select("track_file", "date").filter("date is not null"), "track_file")
    ms = (F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") + F.col("day")) * 86_400_000 + F.col("second").cast("long") * 1000
    timed = dated.withColumn("time_ms", ms)
    out_of_order = _disordered(timed)
    forward = timed.join(out_of_order, ["track_file", "line_no"], "left_anti")
    number = (F.row_number().over(w) - 1).cast("long")
    return forward.select("track_file", number.alias("fix_index"), "time_ms", "lat", "lon", "pressure_alt", "gnss_alt", "valid")


def _disordered(timed: DataFrame) -> DataFrame:
    """(track_file, line_no) of the fixes to drop, by a fold over a file's times, so that those left never run backwards.

    A fix before the last one kept goes, unless it is not before the one kept ahead of that: then the last one
    kept was a spike of the clock, and goes instead.
    """
    files = timed.groupBy("track_file").agg(F.array_sort(F.collect_list(F.struct("line_no", "time_ms"))).alias("times"))  # of one flight
    far = F.lit(-(1 << 62)).cast("long")
    begin = F.struct(far.alias("prior"), far.alias("last"), F.lit(-1).alias("line"), F.expr("cast(array() as array<int>)").alias("out"))

    def add(s: Column, x: Column) -> Column:
        onward = F.struct(s["last"].alias("prior"), x["time_ms"].alias("last"), x["line_no"].alias("line"), s["out"].alias("out"))
        spike = F.struct(s["prior"].alias("prior"), x["time_ms"].alias("last"), x["line_no"].alias("line"), F.concat(s["out"], F.array(s["line"])).alias("out"))
        late = F.struct(s["prior"].alias("prior"), s["last"].alias("last"), s["line"].alias("line"), F.concat(s["out"], F.array(x["line_no"])).alias("out"))
        return F.when(x["time_ms"] >= s["last"], onward).when(x["time_ms"] >= s["prior"], spike).otherwise(late)

    return files.select("track_file", F.explode(F.aggregate("times", begin, add, lambda s: s["out"])).alias("line_no"))


def events(source: DataFrame) -> DataFrame:
    """(track_file, line_no, second of its day, code, description) of event records."""
    layout = r"^E(\d{2})(\d{2})(\d{2})(.{3})(.*)$"
    g = lambda i: F.regexp_extract("line", layout, i)
    second = g(1).cast("int") * 3600 + g(2).cast("int") * 60 + g(3).cast("int")
    sane = g(1).cast("int").between(0, 23) & g(2).cast("int").between(0, 59) & g(3).cast("int").between(0, 59)
    return source.filter(F.col("line").rlike(layout)).filter(sane).select("track_file", "line_no", second.alias("second"), g(4).alias("code"), F.trim(g(5)).alias("description"))


def report(source: DataFrame) -> DataFrame:
    """(track_file, fixes, malformed): fix records by whether they follow the layout."""
    good = F.col("line").rlike(FIX)
    return source.filter(F.col("line").startswith("B")).groupBy("track_file").agg(F.sum(good.cast("long")).alias("fixes"), F.sum((~good).cast("long")).alias("malformed"))


def declared(source: DataFrame) -> DataFrame:
    """(track_file, points): the declared task's points, in order: array<struct<line_no, lat, lon, name, role, area>>.

    The first is the take-off, the second the start, the last the landing, the one before it the finish (of three or
    more points, and four or more); those between are turnpoints. A name may hold an area: its radii, from and to in metres
    (null: no outer one), its bearings and its kind.
    """
    layout = r"^C(\d{2})(\d{5})([NS])(\d{3})(\d{5})([EW])(.*)$"
    inside = r"^(\d{7})(\d{7})(\d{6})(\d{6})(STARTAREA|TURNAREA|FINISHAREA)\s*(.*)$"
    g = lambda i: F.regexp_extract("line", layout, i)
    text = F.trim(g(7))
    a = lambda i: F.regexp_extract(text, inside, i)
    outer = a(2).try_cast("double")
    area = F.when(a(5) != "", F.struct(a(1).try_cast("double").alias("inner"), F.when(outer < NO_LIMIT, outer).alias("outer"), (a(3).try_cast("double") / 1000).alias("bearing1"), (a(4).try_cast("double") / 1000).alias("bearing2"), a(5).alias("kind")))
    name = F.when(a(5) != "", F.trim(F.replace(a(6), F.lit("_"), F.lit(" ")))).otherwise(text)
    rows = source.filter(F.col("line").rlike(layout)).select("track_file", "line_no", _degrees(g(1), g(2), g(3)).alias("lat"), _degrees(g(4), g(5), g(6)).alias("lon"), name.alias("name"), area.alias("area"))
    by, of = W.partitionBy("track_file").orderBy("line_no"), W.partitionBy("track_file")
    placed = rows.withColumns({"_k": F.row_number().over(by), "_n": F.count("*").over(of)})
    role = F.when(F.col("_k") == 1, "takeoff").when(F.col("_k") == 2, "start").when(F.col("_k") == F.col("_n"), "landing").when(F.col("_k") == F.col("_n") - 1, "finish").otherwise("turnpoint")
    return placed.groupBy("track_file").agg(F.array_sort(F.collect_list(F.struct("line_no", "lat", "lon", "name", role.alias("role"), "area"))).alias("points"))


def written_fixes(rows: DataFrame) -> DataFrame:
    """(track_file, line) of fixes as records again: the inverse of the layout, for tests and exports."""
    def angle(x: Column, digits: int, sides: str) -> Column:
        thousandths = F.round(F.abs(x) * 60_000).cast("long")
        whole, rest = F.floor(thousandths / 60_000), thousandths % 60_000
        return F.concat(F.lpad(whole.cast("string"), digits, "0"), F.lpad(rest.cast("string"), 5, "0"), F.when(x < 0, sides[1]).otherwise(sides[0]))

    height = lambda c: F.when(F.col(c) < 0, F.concat(F.lit("-"), F.lpad((-F.col(c)).cast("string"), 4, "0"))).otherwise(F.lpad(F.col(c).cast("string"), 5, "0"))
    second = F.pmod(F.floor(F.col("time_ms") / 1000), F.lit(86_400))
    clock = F.concat(*[F.lpad((F.floor(second / d) % m).cast("string"), 2, "0") for d, m in ((3600, 24), (60, 60), (1, 60))])
    line = F.concat(F.lit("B"), clock, angle(F.col("lat"), 2, "NS"), angle(F.col("lon"), 3, "EW"), F.when(F.col("valid"), "A").otherwise("V"), height("pressure_alt"), height("gnss_alt"))
    return rows.select("track_file", "fix_index", line.alias("line"))

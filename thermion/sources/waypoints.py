"""Waypoint files: readers that give (file, code, name, lat, lon, alt, radius), and writers.

Formats are told by content. Readers are projections over the lines of any number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projections import from_grid, to_grid
from .igc import lines

COLUMNS = ("file", "code", "name", "lat", "lon", "alt", "radius")
FEET = 0.3048


def worked_out(df: DataFrame, **own: Column) -> DataFrame:
    """df with columns that are worked out once a row: the optimizer writes no formula into later ones and filters, however often they name it."""
    for name, value in own.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
    return df


def packed_degrees(text: Column) -> Column:
    """DDMM.mmmN or DDDMM.mmmE as degrees."""
    layout = r"^(\d{2,3})(\d{2}\.\d+)([NSEW])$"
    value = F.regexp_extract(text, layout, 1).try_cast("double") + F.regexp_extract(text, layout, 2).try_cast("double") / 60
    return F.when(F.regexp_extract(text, layout, 3).isin("S", "W"), -value).otherwise(value)


def metres(text: Column) -> Column:
    """"123m" or "403ft" as metres."""
    value = F.regexp_extract(text, r"^\s*(-?[\d.]+)", 1).try_cast("double")
    return F.when(F.lower(text).rlike(r"ft\s*$"), value * FEET).otherwise(value)


def _rows(df: DataFrame, **own: Column) -> DataFrame:
    none = {"alt": F.lit(None).cast("double"), "radius": F.lit(None).cast("double")}
    every = none | own
    placed = worked_out(df, _row=F.struct(*[every[c].alias(c) for c in COLUMNS[1:]])).select(F.col("track_file").alias("file"), "_row.*")
    return placed.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).select(*COLUMNS)


def read_csv(source: DataFrame) -> DataFrame:
    """name, latitude, longitude, description, proximity, altitude; the first line is a header."""
    f = F.split("line", ",")
    part = lambda i: F.trim(F.get(f, F.lit(i)))
    return _rows(source.filter("line_no > 0 and trim(line) <> ''"), code=part(0), name=part(3), lat=part(1).try_cast("double"), lon=part(2).try_cast("double"), alt=part(5).try_cast("double"), radius=part(4).try_cast("double"))


def read_cup(source: DataFrame) -> DataFrame:
    """SeeYou: name, code, country, lat, lon, elev, ...; quoted, until the line of dashes."""
    quoted = F.transform(F.regexp_extract_all(F.concat(F.col("line"), F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), 1), lambda c: F.regexp_replace(c, '^"|"$', ""))
    end = source.filter(F.col("line").startswith("-----")).groupBy("track_file").agg(F.min("line_no").alias("end"))
    body = source.join(end, "track_file", "left").filter("line_no > 0 and (end is null or line_no < end) and trim(line) <> ''").transform(worked_out, f=quoted)
    part = lambda i: F.get("f", F.lit(i))
    return _rows(body, code=F.coalesce(F.nullif(part(1), F.lit("")), part(0)), name=part(0), lat=packed_degrees(part(3)), lon=packed_degrees(part(4)), alt=metres(part(5)))


def read_ozi(source: DataFrame) -> DataFrame:
    """OziExplorer: four header lines; name, lat, lon in fields 2 to 4, long name in 11, altitude (ft) in 15."""
    f = F.split("line", ",")
    part = lambda i: F.trim(F.get(f, F.lit(i)))
    alt = part(14).try_cast("double")
    return _rows(source.filter("line_no > 3 and trim(line) <> ''"), code=part(1), name=part(10), lat=part(2).try_cast("double"), lon=part(3).try_cast("double"), alt=F.when(alt != -777, alt * FEET))


def read_compegps(source: DataFrame) -> DataFrame:
    """CompeGPS: W records with hemisphere letters: W CODE A 46.5N 7.9E date time alt name."""
    layout = r"^W\s+(\S+)\s+A\s+([\d.]+)\S*?([NS])\s+([\d.]+)\S*?([EW])\s+\S+\s+\S+\s+(-?[\d.]+)\s*(.*)$"
    g = lambda i: F.regexp_extract("line", layout, i)
    signed = lambda v, s, neg: F.when(g(s) == neg, -g(v).try_cast("double")).otherwise(g(v).try_cast("double"))
    return _rows(source.filter(F.col("line").rlike(layout)), code=g(1), name=F.trim(g(7)), lat=signed(2, 3, "S"), lon=signed(4, 5, "W"), alt=g(6).try_cast("double"))


def _elements(source: DataFrame, tag: str) -> DataFrame:
    """A row for each element of that name in each file."""
    whole = source.groupBy("track_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return whole.select("track_file", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?is)<{tag}\b.*?</{tag}>"), 0))).select("track_file", F.col("pos").alias("line_no"), F.col("col").alias("line"))


def _inside(tag: str) -> Column:
    plain = F.regexp_extract("line", rf"(?is)<{tag}\b[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{tag}>", 1)
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(letter))
    return F.trim(plain)


def read_gpx(source: DataFrame) -> DataFrame:
    attribute = lambda a: F.regexp_extract("line", rf"""(?i)<wpt\b[^>]*\b{a}\s*=\s*["']([^"']*)["']""", 1).try_cast("double")
    name = F.coalesce(F.nullif(_inside("desc"), F.lit("")), F.nullif(_inside("cmt"), F.lit("")), _inside("name"))
    return _rows(_elements(source, "wpt"), code=_inside("name"), name=name, lat=attribute("lat"), lon=attribute("lon"), alt=_inside("ele").try_cast("double"))


def read_kml(source: DataFrame) -> DataFrame:
    f = F.split(_inside("coordinates"), ",")
    part = lambda i: F.trim(F.get(f, F.lit(i))).try_cast("double")
    return _rows(_elements(source, "Placemark"), code=_inside("name"), name=F.coalesce(F.nullif(_inside("description"), F.lit("")), _inside("name")), lat=part(1), lon=part(0), alt=part(2))


def _words() -> Column:
    return F.split(F.trim("line"), r"\s+")


def _tail(words: Column, at: Column) -> tuple[Column, Column]:
    """(altitude, name) of a line's words from the at-th (from 0) on: the altitude may be missing."""
    first = F.get(words, at)
    number = first.rlike(r"^[+-]?\d+(\.\d+)?$")
    rest = F.slice(words, F.when(number, at + 2).otherwise(at + 1), F.size(words))
    return F.when(number, F.round(first.try_cast("double"))).otherwise(0.0), F.array_join(rest, " ")


def _plain(source: DataFrame) -> DataFrame:
    return source.filter(~F.trim("line").rlike(r"^[$#*]") & (F.trim("line") != "")).transform(worked_out, w=_words())


def _code(words: Column, upto: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), upto), " ")


def read_geo(source: DataFrame) -> DataFrame:
    """$FormatGEO: CODE N dd mm ss.ss E ddd mm ss.ss alt name."""
    at = lambda letters, since: F.get(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i > since) & F.upper(F.get("w", i)).isin(*letters)), F.lit(0))
    placed = worked_out(_plain(source), i=at("NS", F.lit(0)), j=at("EW", F.col("i"))).filter("i >= 1 and j + 3 < size(w)")
    part = lambda i, k: F.get("w", F.col(i) + k).try_cast("double")
    angle = lambda i, neg: (part(i, 1) + part(i, 2) / 60 + part(i, 3) / 3600) * F.when(F.upper(F.get("w", F.col(i))) == neg, -1).otherwise(1)
    placed = placed.withColumns({"lat": angle("i", "S"), "lon": angle("j", "W")})
    alt, name = _tail(F.col("w"), F.col("j") + 4)
    code = _code(F.col("w"), F.col("i"))
    return _rows(placed, code=code, name=F.coalesce(F.nullif(name, F.lit("")), code), lat=F.col("lat"), lon=F.col("lon"), alt=alt)


def read_utm(source: DataFrame) -> DataFrame:
    """$FormatUTM: CODE zone and band, easting, northing, alt, name."""
    at = F.get(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).rlike(r"(?i)^\d{1,2}[C-HJ-NP-X]$")), F.lit(0))
    placed = worked_out(_plain(source), i=at).filter("i >= 1 and i + 2 < size(w)")
    zone = F.get("w", F.col("i"))
    part = lambda k: F.get("w", F.col("i") + k).try_cast("double")
    grid = placed.withColumns({"zone": F.regexp_extract(zone, r"^(\d+)", 1).cast("int"), "northern": F.upper(F.right(zone, F.lit(1))) >= "N", "east": part(1), "north": part(2)})
    found = worked_out(grid, place=from_grid(F.col("zone"), F.col("northern"), F.col("east"), F.col("north")))
    alt, name = _tail(F.col("w"), F.col("i") + 3)
    code = _code(F.col("w"), F.col("i"))
    return _rows(found, code=code, name=F.coalesce(F.nullif(name, F.lit("")), code), lat=F.col("place.lat"), lon=F.col("place.lon"), alt=alt)


READERS = {"geo": read_geo, "utm": read_utm, "csv": read_csv, "cup": read_cup, "ozi": read_ozi, "compegps": read_compegps, "gpx": read_gpx, "kml": read_kml}


def formats(source: DataFrame) -> DataFrame:
    """(track_file, format) by content."""
    head = source.filter("line_no < 20").groupBy("track_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("head"))
    kind = (
        F.when(F.col("head").rlike(r"(?im)^\s*\$FormatGEO"), "geo")
        .when(F.col("head").rlike(r"(?im)^\s*\$FormatUTM"), "utm")
        .when(F.lower("head").contains("<gpx"), "gpx")
        .when(F.lower("head").contains("<kml"), "kml")
        .when(F.col("head").startswith("OziExplorer"), "ozi")
        .when(F.col("head").rlike(r"(?im)^\s*\"?(name|title)\"?,\"?code"), "cup")
        .when(F.col("head").rlike(r"(?m)^W\s+\S+\s+A\s"), "compegps")
        .otherwise("csv")
    )
    return head.select("track_file", kind.alias("format"))


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """All waypoints of the files of a path, whatever their formats."""
    source = lines(spark, path).withColumn("line", F.regexp_replace("line", "^﻿", ""))
    kinds = formats(source)
    out = None
    for kind, reader in READERS.items():
        own = reader(source.join(kinds.filter(F.col("format") == kind), "track_file", "left_semi"))
        out = own if out is None else out.unionByName(own)
    return out


def _packed(x: Column, digits: int, sides: str) -> Column:
    thousandths = F.round(F.abs(x) * 60_000).cast("long")
    minutes = thousandths % 60_000
    return F.concat(F.lpad(F.floor(thousandths / 60_000).cast("string"), digits, "0"), F.lpad(F.floor(minutes / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((minutes % 1000).cast("string"), 3, "0"), F.when(x < 0, sides[1]).otherwise(sides[0]))


def _dms(x: Column, digits: int, sides: str) -> Column:
    """Degrees as letter, degrees, minutes, seconds in hundredths."""
    hundredths = F.round(F.abs(x) * 360_000).cast("long")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    seconds = F.concat(pad(F.floor(hundredths / 100) % 60, 2), F.lit("."), pad(hundredths % 100, 2))
    return F.concat_ws(" ", F.when(x < 0, sides[1]).otherwise(sides[0]), pad(F.floor(hundredths / 360_000), digits), pad(F.floor(hundredths / 6000) % 60, 2), seconds)


def _escaped(x: Column) -> Column:
    for letter, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(letter), F.lit(entity))
    return x


def _number(c: str, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))


#: What comes before and after the records, and a record, of each written format.
WRITERS: dict[str, tuple[str, Column | None, str]] = {}


def writers() -> dict[str, tuple[str, Column, str]]:
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    code, name = F.col("code"), F.coalesce("name", "code")
    grid = to_grid(F.col("lat"), F.col("lon"))
    token = F.format_string("%-9s", F.regexp_replace(code, r"\s+", "_"))
    height = lambda n: F.format_string(f"%{n}d", F.round(F.coalesce(F.col("alt").cast("double"), F.lit(0.0))).cast("long"))
    metre = lambda c: F.format_string("%07d", F.round(c).cast("long"))
    return {
        "geo": ("$FormatGEO", F.concat(token, F.lit(" "), _dms(F.col("lat"), 2, "NS"), F.lit("    "), _dms(F.col("lon"), 3, "EW"), F.lit("   "), height(4), F.lit("  "), name), ""),
        "utm": ("$FormatUTM", F.concat(token, F.lit(" "), grid["zone"].cast("string"), grid["band"], F.lit("   "), metre(grid["easting"]), F.lit("   "), metre(grid["northing"]), F.lit("   "), height(3), F.lit("  "), name), ""),
        "csv": ("Name,Latitude,Longitude,Description,Proximity,Altitude", F.concat_ws(",", F.translate(code, ",", "_"), _number("lat"), _number("lon"), F.translate(name, ",", " "), _number("radius", 0), _number("alt", 0)), ""),
        "cup": ("name,code,country,lat,lon,elev,style", F.concat_ws(",", quote(name), quote(code), F.lit(""), _packed(F.col("lat"), 2, "NS"), _packed(F.col("lon"), 3, "EW"), F.concat(_number("alt", 1), F.lit("m")), F.lit("1")), ""),
        "ozi": ("OziExplorer Waypoint File Version 1.1\nWGS 84\nReserved 2\nReserved 3", F.concat_ws(",", F.lit("-1"), code, _number("lat"), _number("lon"), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("3"), F.lit("0"), F.lit("65535"), F.translate(name, ",", " "), F.lit("0"), F.lit("0"), F.lit("0"), F.format_string("%.4f", F.coalesce("alt", F.lit(0.0)) / FEET)), ""),
        "compegps": ("G  WGS 84\nU  1", F.concat_ws(" ", F.lit("W "), code, F.lit("A"), F.concat(F.format_string("%.9f", F.abs("lat")), F.lit("º"), F.when(F.col("lat") < 0, "S").otherwise("N")), F.concat(F.format_string("%.9f", F.abs("lon")), F.lit("º"), F.when(F.col("lon") < 0, "W").otherwise("E")), F.lit("27-MAR-62 00:00:00"), _number("alt", 1), name), ""),
        "gpx": ('<?xml version="1.0"?>\n<gpx version="1.1">', F.concat(F.lit('<wpt lat="'), _number("lat"), F.lit('" lon="'), _number("lon"), F.lit('"><ele>'), _number("alt", 1), F.lit("</ele><name>"), _escaped(code), F.lit("</name><desc>"), _escaped(name), F.lit("</desc></wpt>")), "</gpx>"),
        "kml": ('<?xml version="1.0"?>\n<kml><Document>', F.concat(F.lit("<Placemark><name>"), _escaped(code), F.lit("</name><description>"), _escaped(name), F.lit("</description><Point><coordinates>"), F.concat_ws(",", _number("lon"), _number("lat"), _number("alt", 1)), F.lit("</coordinates></Point></Placemark>")), "</Document></kml>"),
    }


def write_waypoints(points: DataFrame, path: str, kind: str) -> None:
    """One file of all points (code, name, lat, lon, alt, radius), in order of code: a set of waypoints is small."""
    head, record, tail = writers()[kind]
    body = points.select(F.lit(1).alias("o"), F.col("code").alias("k"), record.alias("value"))
    spark = points.sparkSession
    edge = spark.createDataFrame([(0, "", head), *([(2, "", tail)] if tail else [])], "o int, k string, value string")
    edge.union(body).coalesce(1).sortWithinPartitions("o", "k").select("value").write.mode("overwrite").text(path)


def unique_codes(points: DataFrame) -> DataFrame:
    """points with codes free of spaces and commas; repeated ones (whatever their case) get a number from 2, skipping codes in use."""
    clean = points.withColumn("code", F.regexp_replace("code", r"[\s,]+", "_"))
    from pyspark.sql import Window as W

    w = W.partitionBy("file", F.lower("code")).orderBy("lat", "lon", "name")
    numbered = clean.withColumn("_n", F.row_number().over(w))
    taken = clean.select("file", F.lower("code").alias("_taken")).distinct()
    # the candidates of a repeated code are as many as its repeats and the suffixed codes already there
    wide = numbered.groupBy("file", F.lower("code").alias("_k")).agg(F.max("_n").alias("_most")).filter("_most > 1")
    tried = wide.withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("_most") * 2 + 20))).withColumn("_taken", F.concat("_k", F.col("_i").cast("string")))
    free = tried.join(taken, ["file", "_taken"], "left_anti").withColumn("_n", F.row_number().over(W.partitionBy("file", "_k").orderBy("_i")) + 1).select("file", "_k", "_n", "_i")
    joined = numbered.withColumn("_k", F.lower("code")).join(free, ["file", "_k", "_n"], "left")
    return joined.withColumn("code", F.concat("code", F.coalesce(F.when(F.col("_n") > 1, F.col("_i").cast("string")), F.lit("")))).select(*points.columns)

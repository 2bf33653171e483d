"""Text as pages and lists show it: escaping, masks, keys, ordinals, durations, and coordinates and times read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_text(x: Column) -> Column:
    """Without tags, and with the five characters that markup gives a meaning written as entities; null is empty."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def masked_email(x: Column) -> Column:
    """The first letter and the domain; three stars where there is no domain, null for nothing."""
    parts = F.split(x, "@")
    domain = F.get(parts, F.lit(1))
    return F.when(x != "", F.when(domain != "", F.concat(F.substring(parts[0], 1, 1), F.lit("***@"), domain)).otherwise("***"))


def name_key(x: Column) -> Column:
    """Lower case, one space between words, none at the ends; marks stay."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), " +", " "))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    last = n % 10
    end = F.when((n % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def rank_label(position: Column, of: Column, tied: Column, superlative: str) -> Column:
    """Fastest of 12; Equal 3rd fastest of 12."""
    phrase = F.concat(F.when(tied, "equal ").otherwise(""), F.when(position > 1, F.concat(ordinal(position), F.lit(" "))).otherwise(""), F.lit(superlative), F.lit(" of "), of.cast("string"))
    return F.concat(F.upper(F.substring(phrase, 1, 1)), F.substr(phrase, F.lit(2)))


def duration(seconds: Column) -> Column:
    """h:mm:ss, under an hour mm:ss, of seconds rounded down."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    low = F.format_string("%02d:%02d", m, rest)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), low)).otherwise(low)


def time_of_day(x: Column) -> Column:
    """Seconds since midnight of HH:MM, HH:MM:SS or HH:MM:SSZ; null for anything else."""
    pattern = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?Z?$"
    part = lambda i: F.regexp_extract(F.trim(x), pattern, i).try_cast("int")
    h, m, s = part(1), part(2), F.coalesce(part(3), F.lit(0))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)


def coordinate(x: Column) -> Column:
    """Degrees of a decimal number, or of degrees and minutes written together with a letter after them: 3603.250S is -(36 + 3.25 / 60)."""
    t = F.trim(x)
    packed = r"^(\d+)(\d{2}(?:\.\d*)?)\s*([NSEWnsew])$"
    part = lambda i: F.regexp_extract(t, packed, i)
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60
    return F.when(t.rlike(packed), F.when(F.upper(part(3)).isin("S", "W"), -value).otherwise(value)).otherwise(t.try_cast("double"))


def date_words(x: Column) -> Column:
    """What a date is searched by: itself, its month's name and its year; null is empty, other texts stay."""
    day = F.to_date(F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))
    return F.when(x.isNull(), "").when(day.isNotNull(), F.concat_ws(" ", x, F.lower(F.date_format(day, "MMMM")), F.year(day).cast("string"))).otherwise(x)


def list_words(json: Column) -> Column:
    """The texts of a JSON list, space-joined; empty for anything else."""
    return F.coalesce(F.array_join(F.from_json(json, "array<string>"), " "), F.lit(""))


def overlap(a: Column, b: Column) -> Column:
    """How many members two sets share."""
    return F.size(F.array_intersect(a, b))

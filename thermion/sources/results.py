"""Published results: rows of a JSON table by position, with the pilot's name and track in a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import half_up

# Fixed positions of a row.
RANK, PILOT, LINK, NATION, GLIDER, CLASS, START, FINISH, TOOK, DISTANCE, SPEED, SCORE = 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 14, 16


def rows(text: Column) -> Column:
    """An array of rows of strings (null where a cell is null)."""
    return F.from_json(text, "array<array<string>>")


def result(row: Column) -> Column:
    """struct<rank, pilot_id, name, track_id, nation, glider, class, start, finish, took, distance, speed, score> of a row: numbers that are none are 0, empty texts of times null, scores whole, ranks null where they are no number."""
    cell = lambda i: F.coalesce(F.get(row, F.lit(i)), F.lit(""))
    number = lambda i: F.coalesce(F.regexp_extract(F.replace(cell(i), F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0).try_cast("double"), F.lit(0.0))
    text = lambda i: F.nullif(cell(i), F.lit(""))
    plain = F.trim(F.regexp_replace(cell(LINK), "<[^>]*>", ""))
    track = F.nullif(F.regexp_extract(cell(LINK), r"trackid=(\d+)", 1), F.lit(""))
    return F.struct(
        F.regexp_extract(cell(RANK), r"^\s*(\d+)", 1).try_cast("int").alias("rank"), cell(PILOT).alias("pilot_id"), plain.alias("name"), track.alias("track_id"), cell(NATION).alias("nation"), cell(GLIDER).alias("glider"), cell(CLASS).alias("class"),
        text(START).alias("start"), text(FINISH).alias("finish"), text(TOOK).alias("took"), number(DISTANCE).alias("distance"), number(SPEED).alias("speed"), half_up(number(SCORE)).cast("long").alias("score"),
    )

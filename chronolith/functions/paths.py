"""Path and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without a dot, or with only a leading one."""
    found = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(basename(path).rlike(r"^.+\.[^.]*$"), found)


def short_name(path: Column, most: int = 15) -> Column:
    """The file name, cut to ``most - 3`` characters and three dots if it is longer than ``most``."""
    name = basename(path)
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def short_id(commit: Column) -> Column:
    return F.substring(commit, 1, 8)


def first_line(message: Column) -> Column:
    return F.element_at(F.split(F.coalesce(message, F.lit("")), r"\r?\n", 2), 1)


def people(first: Column, count: Column) -> Column:
    """``Unknown``, up to three names, or two names and how many more there are; ``first`` holds the first three names."""
    return (
        F.when(first.isNull() | (F.size(first) == 0), F.lit("Unknown"))
        .when(count <= 3, F.array_join(first, ", "))
        .otherwise(F.concat(F.array_join(F.slice(first, 1, 2), ", "), F.lit(" and "), count - 2, F.lit(" more")))
    )


def day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def second(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def author_key(name: Column, email: Column) -> Column:
    return F.concat_ws(":", F.coalesce(name, F.lit("")), F.coalesce(email, F.lit("")))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")

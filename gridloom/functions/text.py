"""Names, labels and log lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of classes, in order.
CLASS_COLOURS = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]
#: What marks a progress line beside a bar, and beginnings that mark content.
PROGRESS_MARKS = ["%", "it/s", "s/it", "frame/s", "img/s", "batch", "prop"]
CONTENT_STARTS = ["[", "=", "✅", "❌", "⚠", " Done", " Script"]

CROP_NAME = r"^(.+)_cls(\d+)_(\d+)$"


def crop_name(stem: Column, cls: Column, index: Column) -> Column:
    return F.format_string("%s_cls%d_%d", stem, cls, index)


def crop_part(name: Column, group: int) -> Column:
    """Stem (1), class (2) or index (3) of a crop's name; null where it is none. The last marker counts."""
    return F.nullif(F.regexp_extract(name, CROP_NAME, group), F.lit(""))


def class_colour(cls: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASS_COLOURS]), (F.pmod(cls, F.lit(len(CLASS_COLOURS))) + 1).cast("int"))


def class_label(cls: Column, name: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("cls"), cls.cast("string")))


def is_progress_line(line: Column) -> Column:
    """A progress bar without content; markers that begin with a space never match, as the line is trimmed first."""
    s = F.trim(line)
    bar, starts = F.lit(False), F.lit(False)
    for mark in PROGRESS_MARKS:
        bar |= s.contains(mark)
    for start in CONTENT_STARTS:
        starts |= s.startswith(start)
    return s.contains("|") & bar & ~starts


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def log_lines(text: Column) -> Column:
    """Lines of a text, split at \\r\\n, \\r or \\n."""
    return F.split(text, r"\r\n|\r|\n", -1)

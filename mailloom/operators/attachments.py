"""Attachment rules over arrays of file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_NAME = 100


def dangerous(names: Column) -> Column:
    """The names with an executable extension, in order."""
    return F.filter(names, lambda x: F.lower(x).rlike(r"\.(exe|scr|pif)$"))


def odd_archives(names: Column) -> Column:
    """The archives with a name of more than 100 characters, in order."""
    return F.filter(names, lambda x: F.lower(x).rlike(r"\.(zip|rar|7z)$") & (F.length(x) > LONG_NAME))

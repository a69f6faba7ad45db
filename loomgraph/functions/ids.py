"""Identifier normalisation shared by the operators that compare references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters trimmed from identifiers: ASCII control spaces and the Unicode space separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def clean_id(column: Column) -> Column:
    """Trimmed of white space (tabs and Unicode spaces too), lower-cased; null becomes ''."""
    return F.lower(F.btrim(F.coalesce(column, F.lit("")), F.lit(WHITE)))


def utc_month(column: Column) -> Column:
    """``YYYY-MM`` of a timestamp; the session runs in UTC."""
    return F.date_format(column, "yyyy-MM")

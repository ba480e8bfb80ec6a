"""Column helpers for text; all native expressions, linear in the text length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, NBSP and the ideographic space included.
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(c: Column) -> Column:
    """Trim all white space; Spark's own ``trim`` takes off blanks only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def without_bold(c: Column) -> Column:
    return F.replace(c, F.lit("**"), F.lit(""))

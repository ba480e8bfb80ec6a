"""The order in which rows were loaded, as a sortable column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOAD_NO = "load_no"


def load_number(paths: str | Sequence[str]) -> Column:
    """Sorts rows as they were loaded: by given path, then file, then place in it. For use right on top of a scan.

    Taken from what the reader knows of each row's file and split and from the
    row's place in the split, it is the same however the table is partitioned
    later, and in a retried task.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    file = F.col("_metadata.file_path")
    # With a slash behind both, a path matches itself and what lies in it, but not a longer name.
    holds = lambda p: F.contains(F.concat(file, F.lit("/")), F.lit(f"{p.split(':', 1)[-1].rstrip('/')}/"))
    place = F.coalesce(*[F.when(holds(p), F.lit(i)) for i, p in reversed(list(enumerate(given)))], F.lit(len(given)))
    return F.struct(
        place.alias("path"), file.alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )

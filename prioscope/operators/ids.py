"""Dense row positions in file order, without moving rows to one task.

Position = (rows in all earlier file splits) + (row's index inside its split). The
per-split counts form a table with one row per file split (a few hundred thousand at
100 TB); only that table is ordered by a global window. The rows themselves never
leave their partition except for a join with that small table, which AQE broadcasts
when its measured size allows.

The scan must be deterministic between the count pass and the numbering pass; file
scans are (same files, same splits), which is also what makes a lost executor's
recomputation produce the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_F, _B, _M = "__pos_file", "__pos_block", "__pos_mid"


def tag_scan(df: DataFrame) -> DataFrame:
    """Attach file / split / in-partition order tags. Call right on a file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(_F),
        F.col("_metadata.file_block_start").alias(_B),
        F.monotonically_increasing_id().alias(_M),
    )


def with_position(tagged: DataFrame, out: str = "pos") -> DataFrame:
    """0-based dense position in (file path, byte offset, row) order; drops the tags."""
    seg = (tagged.groupBy(_F, _B)
           .agg(F.count(F.lit(1)).alias("__n"), F.min(_M).alias("__m0")))
    before = Window.orderBy(_F, _B).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(_F, _B, "__m0",
                     F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (tagged.join(seg, [_F, _B])
            .withColumn(out, F.col("__off") + F.col(_M) - F.col("__m0"))
            .drop(_F, _B, _M, "__m0", "__off"))


def ticket_id_from_position(pos_col: str = "pos"):
    """``TKT_`` + position zero-padded to 5 digits (wider positions keep all digits)."""
    return F.format_string("TKT_%05d", F.col(pos_col))

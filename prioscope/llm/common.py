"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.session import materialize

#: The white space of the contracts: \x20 and \x09-\x0D, nothing else.
SPACES = " \t\n\x0b\x0c\r"
_SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def find_package(spark: SparkSession) -> None:
    """Let Python workers that see the driver's installation of this package import it; on a
    cluster it is installed or sent with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), root])


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` written once with a number for each row: a key that holds for null and repeated ids."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs of a text; null and blank texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, _SPACE_CLASS))).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; ``bytes`` lower and split are ASCII-only, so the
    separators are exactly \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").lower().split()


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch's columns (Python lists) to output
    columns. Batches are bounded by Spark's Arrow batch limits, never by a partition."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    find_package(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)

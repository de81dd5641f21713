"""Dossier and prediction sinks / sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from prioscope.operators.dossier import EVIDENCE_TYPE

DOSSIER_SCHEMA = (
    "ticket_id string, assigned_priority string, inferred_severity string, "
    "mismatch_type string, severity_delta int, feature_evidence " + EVIDENCE_TYPE
    + ", constraint_analysis string, confidence double"
)


def write_dossiers(dossiers: DataFrame, path: str, dossier_col: str = "dossier",
                   mode: str = "errorifexists") -> None:
    """JSON lines, one dossier per line (partitioned output, not one array file)."""
    dossiers.select(F.col(f"{dossier_col}.*")).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON-lines dossiers as a ``dossier`` struct with the raw line in ``dossier_json``
    (the validator tells an absent key from a null by it); an absent path gives an empty table
    with the same schema."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines = spark.read.text(path) if fs.exists(fs_path) else spark.createDataFrame([], "value string")
    parsed = F.from_json("value", DOSSIER_SCHEMA)
    return lines.select(parsed.alias("dossier"), F.col("value").alias("dossier_json")).select(
        "dossier.ticket_id", "dossier", "dossier_json")


class DossierStore:
    """Append-only store of dossiers (S8): Parquet under ``path`` in buckets of hashed ticket ids.

    ``append`` adds dossiers and touches no earlier file; an id may be appended again, and
    ``read`` gives the row of its last append. ``pending`` finds the tickets without a dossier:
    a Bloom filter of the stored ids settles most new tickets without a join, and only rows
    that it cannot rule out are anti-joined with the ids, so its false positives cost a join
    and never a ticket.
    """

    #: Buckets of the store, bits of the filter at most (16 MB) and per id, hashes.
    BUCKETS, MAX_BITS, BITS_PER_ID, HASHES = 64, 1 << 27, 12, 4

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)

    def append(self, dossiers: DataFrame, dossier_col: str = "dossier") -> None:
        """Add ``ticket_id`` and its dossier struct."""
        number = (self._rows().agg(F.max("appended")).first()[0] or 0) + 1
        rows = dossiers.select(F.col(dossier_col)["ticket_id"].alias("ticket_id"), F.col(dossier_col).cast(f"struct<{_struct(DOSSIER_SCHEMA)}>").alias("dossier"))
        bucket = F.pmod(F.xxhash64("ticket_id"), F.lit(self.BUCKETS)).cast("int")
        (rows.withColumn("appended", F.lit(number)).withColumn("bucket", bucket).repartition("bucket")
         .write.mode("append").partitionBy("bucket").parquet(self.path))

    def _rows(self) -> DataFrame:
        schema = f"ticket_id string, dossier struct<{_struct(DOSSIER_SCHEMA)}>, appended int, bucket int"
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        """``ticket_id, dossier``: the last appended dossier of each ticket."""
        return self._rows().groupBy("bucket", "ticket_id").agg(F.max_by("dossier", "appended").alias("dossier")).drop("bucket")

    def _places(self, bits: int) -> list:
        return [F.pmod(F.xxhash64(F.col("ticket_id"), F.lit(i)), F.lit(bits)) for i in range(self.HASHES)]

    def id_filter(self) -> tuple[DataFrame, int]:
        """One row ``words array<bigint>`` and its number of bits, a power of two from the stored
        rows (counted in file footers)."""
        n, bits = self._rows().count(), 1 << 12
        while bits < n * self.BITS_PER_ID and bits < self.MAX_BITS:
            bits *= 2
        place = self._rows().where("ticket_id IS NOT NULL").select(F.explode(F.array(*self._places(bits))).alias("place"))
        words = place.groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("word"))
        full = self.spark.range(bits // 64).join(words, "id", "left")  # bounded by MAX_BITS
        return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))),
                                    lambda w: w["word"]).alias("words")), bits

    def pending(self, tickets: DataFrame) -> DataFrame:
        """Rows of ``tickets`` (written once by the caller where their plan is expensive) without a
        stored dossier; rows without an id are pending."""
        if not self._exists():
            return tickets
        words, bits = self.id_filter()
        known = F.lit(True)
        for place in self._places(bits):
            known = known & (F.getbit(F.element_at("__words", (F.shiftright(place, 6) + 1).cast("int")), (place % 64).cast("int")) == 1)
        marked = tickets.crossJoin(F.broadcast(words.withColumnRenamed("words", "__words"))).withColumn("__known", F.coalesce(known, F.lit(False)))
        marked = marked.drop("__words")
        stored = self._rows().select("ticket_id").distinct()
        unsure = marked.where("__known").join(stored, "ticket_id", "left_anti").select(*tickets.columns)
        return marked.where("NOT __known").select(*tickets.columns).union(unsure)


def _struct(ddl: str) -> str:
    """Fields of a DDL schema in the notation of a struct type."""
    return _parse_datatype_string(ddl).simpleString()[len("struct<"):-1]


def write_predictions_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; array columns are pipe-joined only here, at the edge."""
    cols = [F.array_join(F.col(c), "|").alias(c) if t.startswith("array") else F.col(c)
            for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)

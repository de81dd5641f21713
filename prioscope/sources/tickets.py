"""Raw ticket exports: CSV (or Parquet) scan, header normalisation, rename map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.operators.ids import tag_scan, ticket_id_from_position, with_position
from prioscope.sources.csv_records import SURPLUS, parsed, read_records

# FIXED VALUES — field texts a pandas CSV read turns into missing values.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# FIXED VALUES — export header (after normalisation) -> canonical column name.
COLUMN_MAP = {
    "ticket_subject": "subject",
    "ticket_description": "description",
    "customer_email": "customer_email",
    "priority_level": "priority",
    "ticket_channel": "channel",
    "resolution_time_hours": "resolution_hours",
    "issue_category": "ticket_type",
}


_FILE, _RECORD = "__file", "__record"


def normalise_header(name: str) -> str:
    """strip -> lower -> spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_header(c) for c in df.columns])


def apply_column_map(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Rename the export headers that are present; refuse to create duplicate names."""
    mapping = COLUMN_MAP if mapping is None else mapping
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    clash = [v for k, v in present.items() if v in df.columns]
    if clash:
        raise ValueError(f"rename would duplicate existing column(s): {sorted(clash)}")
    return df.withColumnsRenamed(present) if present else df


def na_to_null(df: DataFrame, tokens=None) -> DataFrame:
    """Missing-value tokens -> null on every string column (exact field match)."""
    tokens = NA_TOKENS if tokens is None else list(tokens)
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype == "string":
            c = F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def _united(records: DataFrame, heads: list[tuple[str, list[str]]], rename: bool) -> DataFrame:
    """Fields of all headers by their canonical names: one column each, from the header that has it."""
    source: dict[str, list] = {}
    for i, (_, names) in enumerate(heads):
        seen = set()
        for raw in names:
            name = normalise_header(raw)
            name = COLUMN_MAP.get(name, name) if rename else name
            if name in seen:
                raise ValueError(f"rename would duplicate existing column(s): [{name!r}]")
            seen.add(name)
            source.setdefault(name, []).append(F.col(f"h{i}").getField(raw))
        source.setdefault(SURPLUS, []).append(F.col(f"h{i}").getField(SURPLUS))
    wide = parsed(records, heads)
    return wide.select(*[(F.coalesce(*cs) if len(cs) > 1 else cs[0]).alias(n) for n, cs in source.items()], "__row_pos", F.col("file").alias(_FILE), F.col("record").alias(_RECORD))


def read_tickets(spark: SparkSession, path: str, fmt: str = "csv",
                 rename: bool = True, na_tokens=None, fill_ids: bool = True,
                 multi_line: bool = True, surplus: str = "drop", rejects: str | None = None) -> DataFrame:
    """Scan a ticket export: every field as text, header normalised and renamed.

    ``path`` may be a directory or a glob: all files are read (no "first file only"). Files
    are read by their own headers and united by column name, so columns may stand in another
    order or be absent in some files. Rows with fewer fields than the header get nulls; rows
    with more are refused unless ``surplus="keep"`` keeps them without the fields past the
    header. ``rejects`` names a folder to which the refused records are written as they are
    (see ``rejected_records``), so that none vanishes.

    Quoted fields may hold newlines, and every file is still read by as many tasks as it has
    splits (``sources.csv_records``); with ``multi_line=False`` a newline always ends a record.
    Without a ``ticket_id`` column, ids ``TKT_%05d`` are made from the row position in file
    order, refused rows included.
    """
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        fill = fill_ids and "ticket_id" not in map(normalise_header, df.columns)
        df = normalise_columns(df) if not fill else (lambda t: t.toDF(*[normalise_header(c) for c in df.columns], *t.columns[len(df.columns):]))(tag_scan(df))
        df = na_to_null(df, na_tokens)
        df = apply_column_map(df) if rename else df
        if fill:
            df = with_position(df, "__row_pos")
            df = df.withColumn("ticket_id", ticket_id_from_position("__row_pos")).drop("__row_pos")
        return df
    heads, records = read_records(spark, path, multi_line)
    if not heads:
        raise ValueError(f"no CSV file with a header at {path}")
    rows = _united(records, heads, rename)
    if rejects:
        _rejected(rows).write.mode("error").json(rejects)
    if surplus != "keep":
        rows = rows.where(F.col(SURPLUS).isNull())
    fields = na_to_null(rows.drop(SURPLUS, _FILE, _RECORD), na_tokens)
    if fill_ids and "ticket_id" not in fields.columns:
        fields = fields.withColumn("ticket_id", ticket_id_from_position("__row_pos"))
    return fields.drop("__row_pos")


def _rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(SURPLUS).isNotNull()).select(
        F.col(_FILE).alias("file"), F.col("__row_pos").alias("position"), F.col(f"`{rows.columns[0]}`").alias("first_field"), F.col(SURPLUS).alias("surplus_field"), F.col(_RECORD).alias("record"))


def rejected_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rejects of ``read_tickets``: rows of a CSV path with more fields than their header, as ``file,
    position, first_field, surplus_field`` (the first one past the header) and the whole ``record``."""
    heads, records = read_records(spark, path, multi_line)
    if not heads:
        return spark.createDataFrame([], "file string, position long, first_field string, surplus_field string, record string")
    return _rejected(_united(records, heads, rename=False))


def surplus_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``first_field, surplus_field`` of the rejects (see ``rejected_records``)."""
    return rejected_records(spark, path, multi_line).select("first_field", "surplus_field")

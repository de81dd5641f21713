"""Training-set preparation: model input text, class weights, exact stratified split.

The split is exact (same counts as ranking every class by a seeded hash) without a
per-class window over all rows: rows are counted per (class, hash-prefix bucket), the
small bucket table gives each bucket's rank offset, and rows are ranked only inside
their bucket. A class that holds a third of all rows is still spread over
``16 ** prefix`` evenly filled window partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prioscope.functions.scoring import hours_text
from prioscope.session import materialize

# FIXED VALUES — metadata prefix of the classifier input, and split shares / seed.
MODEL_INPUT_FORMAT = "[CHANNEL: %s] [RESOLUTION_TIME: %s] [TYPE: %s] %s"
SPLIT_SEED = 42
SPLIT_CUTS = (0.70, 0.85)  # train | val | test = 70 / 15 / 15
#: Rows of a rank window on average, and the longest prefix (its offsets table is still broadcast).
BUCKET_ROWS = 1 << 20
MAX_PREFIX = 5


def with_model_input(df: DataFrame, max_chars: int | None = None,
                     out: str = "model_input") -> DataFrame:
    """``[CHANNEL: c] [RESOLUTION_TIME: x.x hours] [TYPE: t] text``, whole texts; a caller may
    ask for a cut to ``max_chars``."""
    def s(c, default):
        return F.coalesce(F.col(c).cast("string"), F.lit(default))
    text = F.format_string(MODEL_INPUT_FORMAT, s("channel", "unknown"),
                           hours_text(F.col("resolution_hours")),
                           s("ticket_type", "unknown"), s("full_text", ""))
    if max_chars:
        text = F.substring(text, 1, max_chars)
    return df.withColumn(out, text)


def class_weights(df: DataFrame, label: str = "mismatch_label") -> DataFrame:
    """Balanced weights n / (k * n_c) per class (k = number of classes present)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"))
    return (per.crossJoin(F.broadcast(tot))
            .select(label, "n", (F.col("n_total") / (F.col("k") * F.col("n"))).alias("weight")))


def imbalance(df: DataFrame, label: str = "mismatch_label") -> DataFrame:
    y = F.col(label)
    return df.agg(F.count_if(y == 0).alias("n_consistent"),
                  F.count_if(y == 1).alias("n_mismatch")).select(
        "n_consistent", "n_mismatch",
        (F.col("n_mismatch") / (F.col("n_consistent") + F.col("n_mismatch"))).alias("share_mismatch"),
        (F.col("n_consistent") / F.greatest(F.col("n_mismatch"), F.lit(1))).alias("ratio"))


def split_key(id_col: str = "ticket_id", seed: int = SPLIT_SEED):
    """Seeded, uniformly spread sort key: md5 hex of ``id|seed``."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str = "mismatch_label", id_col: str = "ticket_id",
                     seed: int = SPLIT_SEED, cuts=SPLIT_CUTS, prefix: int | None = None,
                     out: str = "split") -> DataFrame:
    """Exact stratified train/val/test assignment.

    Within each class, rows ranked by (md5(id|seed), id) get ``train`` for rank <=
    floor(n * cuts[0]), ``val`` for rank <= floor(n * cuts[1]), else ``test``.

    The rows are written once with their hash, so an expensive upstream plan (text scoring)
    runs a single time; both passes read that table. Pass 1 counts rows per (class,
    hash-prefix bucket), whose running sums (a window over that small table) give each
    bucket's rank offset. Pass 2 ranks rows inside their bucket with a window partitioned by
    (class, bucket), many evenly filled partitions even when one class holds most rows, and
    adds the offset. The length of the prefix follows the number of rows (a bucket holds
    ``BUCKET_ROWS`` at most, on average); ``prefix`` sets it by hand.
    """
    keyed = materialize(df.withColumn("__h", split_key(id_col, seed)), "split-input")
    if prefix is None:
        n = keyed.count()  # from the written files' footers
        prefix = 1
        while n > BUCKET_ROWS * 16 ** prefix and prefix < MAX_PREFIX:
            prefix += 1
    c1, c2 = cuts
    keyed = keyed.withColumn("__b", F.substring("__h", 1, prefix))
    buckets = keyed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    offsets = buckets.select(
        label, "__b",
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"),
        F.floor(F.sum("__n").over(whole) * c1).alias("__k1"),
        F.floor(F.sum("__n").over(whole) * c2).alias("__k2"),
    )
    in_bucket = Window.partitionBy(label, "__b").orderBy("__h", id_col)
    ranked = keyed.withColumn("__r", F.row_number().over(in_bucket))
    # The offsets table is bounded by #classes * 16**MAX_PREFIX rows: a proven size bound.
    joined = ranked.join(F.broadcast(offsets), [label, "__b"])
    r = F.col("__before") + F.col("__r")
    split = F.when(r <= F.col("__k1"), "train").when(r <= F.col("__k2"), "val").otherwise("test")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], split.alias(out))

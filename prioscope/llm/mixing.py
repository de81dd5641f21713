"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are ordered by that
key: the key's first digits are range buckets, so a hot source is spread over thousands of
small sorted ranges. Distributed prefix sums (a sum per range, offsets over the small
table of ranges, a running sum inside each range) say where each document lies on its
source's line of words, and the line is cut at the source's budget; budgets beyond a
source's size repeat it in whole epochs first.

Defined results: a null text has no words; null sources are one source, ordered last;
rows that repeat an id are separate documents; documents without words take nothing; an
empty table gives an empty result. Only the named columns are read, so other columns of
any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.common import numbered, word_count
from prioscope.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name a range: 16**3 ranges in each source.
RANGE_DIGITS = 3


def targets(sizes: dict[str | None, int], weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Target words of each source: shares of the total by weight (sources by code point,
    null last, take the weights in turn), never above ``max_epochs`` times the source; what
    is cut off is shared again by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(w[s] for s in free)
        full = [s for s in free if unit * w[s] > max_epochs * sizes[s]]
        if not full:
            return {s: out.get(s, unit * w[s]) for s in order}
        for s in full:
            out[s] = float(max_epochs * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def mix(docs: DataFrame, seed: int = 42, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``, and ``row_col``
    if it is named: how many words of it the mix takes (whole epochs, then up to the cut). The
    driver sees one row per source: the recipe itself."""
    spark = docs.sparkSession
    rows_key = [row_col] if row_col else []
    narrow = materialize(docs.select(
        *rows_key,
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
        F.xxhash64(text_col).alias("tie")), "mix")
    sizes = {r["src"]: r["n"] for r in narrow.groupBy("src").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights, max_epochs)
    recipe = spark.createDataFrame(
        [(i, s, sizes[s], float(goal[s])) for i, s in enumerate(sizes)],
        "sid int, src string, source_size long, target double")
    rows = narrow.join(recipe, narrow.src.eqNullSafe(recipe.src)).select(
        *rows_key, "doc_id", "size", "key", "tie", "sid", "source_size", "target", F.substring("key", 1, RANGE_DIGITS).alias("range"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("sid", "range").agg(F.sum("size").alias("n")).select(
        "sid", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "tie", *rows_key).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0))
    return (rows.join(offsets, ["sid", "range"])
            .withColumn("at", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .withColumn("epochs", epochs)
            .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
            .select(*rows_key, "doc_id", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at")))).cast("long").alias("taken")))


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: one row per whole copy, and a last row whose
    text ends at the cut word where a copy is taken in part. Rows are found by ``row_col``;
    without it by their ids, which must be unique then (null is one of them)."""
    p = plan.where("taken > 0").select(F.col(row_col or "doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    part = F.col("__taken") - F.col("__copy") * F.col("__size")
    words = F.split(F.col(text_col), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each with the white space after it
    leading = F.when(F.col(text_col).rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), (part + leading).cast("int")), "")
    got = docs.join(p, docs[row_col] == p["__id"] if row_col else docs[id_col].eqNullSafe(p["__id"])).withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__taken") / F.col("__size")) - 1).cast("int"))))
    cut = F.when(part < F.col("__size"), head).otherwise(F.col(text_col))
    return got.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them, whatever their ids: null and repeated ids are rows of their own."""
    rows = numbered(docs)
    plan = mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, row_col="__row")
    return apply_mix(rows, plan, id_col, text_col, row_col="__row").select(docs.columns)

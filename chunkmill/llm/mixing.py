"""Mixing sources to target weights, in DataFrame operations.

Every row gets a hash-random key from its id and text. Keys are uniform, so ranges of equal width hold equal shares: rows are sorted
within (source, range), sums of ranges give each range its offset, and a row's prefix sum is its range's offset plus
its running sum there. A source's budget is cut exactly: whole epochs first, then rows by key until it is used up;
the row that crosses the budget gives its first words.

Defined cases: null texts have size 0 and are taken 0 times; a null source is one source, sorted last; null or
repeated doc_ids are rows like others, told apart by their texts, then by what else is kept of them, and only equal rows
tie; texts of any length count whole; an empty table gives no rows; with no words at all every target is 0; extra
columns are passed over or, in the mix, carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the whole table to each range of keys (so a range of a source has this many at most, on average).
RANGE_ROWS = 20_000
WEIGHTS, EPOCHS, SEED = (5.0, 2.0, 1.0), 3, "mix"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to those and target: shares of all sizes by weight, stopping at epochs * source_size."""
    # a rank over all sources without one task that sorts them: ranges of sources, then an offset for each range
    ranged = scratch(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1)
    weighed = scratch(ranged.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")), "weighed")  # a row for each partition
    level, full = 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.col("weight") * level
        total, capped, open_weight, now = weighed.agg(F.sum("source_size"), F.sum(F.when(at_cap, F.col("cap")).otherwise(0)), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))), F.sum(at_cap.cast("int"))).first()
        if now == full or not open_weight:
            break
        level, full = (total - capped) / open_weight, now
    return weighed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def mixture(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target (of the source) and taken (words, repeats counted) for every row; keep: other columns to carry."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = documents.count()
    ranges = 1
    while ranges * RANGE_ROWS < rows:
        ranges *= 2
    ranges = max(ranges, 64)
    part = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("long")
    sized = documents.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.xxhash64("text", *keep).alias("tie"), *keep).withColumn("part", part)
    sums = scratch(sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "ranges")
    aimed = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, epochs)
    offset = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("offset", offset).join(aimed.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    offsets = offsets.select(F.col("source").alias("s"), F.col("part").alias("p"), "offset", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("inside", inside).join(offsets, F.expr("source <=> s and part = p"))
    budget = F.round("target").cast("long")
    epoch = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epoch * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epoch * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of documents: a row for every time it is taken; a part of a row keeps its first words."""
    names = documents.columns
    # the row is one column, so no name of its columns can clash
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", "row.doc_id", "row.source", "row.text")
    planned = mixture(row, weights, epochs, seed, ("row",)).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = planned.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.array_repeat(part, (part > 0).cast("int")))))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(first)
    own = {c: F.col(f"row.`{c}`") for c in names} | {"text": text}
    if "n_chars" in names:
        own["n_chars"] = F.when(F.col("words") == F.col("size"), F.col("row.n_chars")).otherwise(F.length(text)).cast(documents.schema["n_chars"].dataType)
    return copies.select(*[own[c].alias(c) for c in names])

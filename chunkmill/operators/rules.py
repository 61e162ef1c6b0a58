"""Include and exclude rules of a directory tree, from marker files.

`.backup` and `.no-backup` in a directory decide for it and all below, until another marker does; with both, it is
included. `.backup-X` and `.no-backup-X` decide for the entry X next to them; the former is looked at only where the
directory is excluded, the latter where it is included. Links to directories are not followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decided(tree: DataFrame, included: bool = True) -> DataFrame:
    """(path, included, flips) of every entry; tree: path, parent, name, is_dir, is_symlink. One join a level of depth.

    The root has a null parent; flips marks entries whose state differs from their parent's: the lists' lines.
    """
    entries = tree.select("path", "parent", "name", "is_dir", "is_symlink")
    # of exclusions a directory of that name counts as well, of inclusions only a file
    yes = entries.where("name = '.backup' and not is_dir").select(F.col("parent").alias("path"), F.lit(True).alias("yes")).distinct()
    no = entries.where("name = '.no-backup'").select(F.col("parent").alias("path"), F.lit(True).alias("no")).distinct()
    named = lambda prefix, as_: entries.where(F.col("name").startswith(prefix) & ~F.col("is_dir")).select(F.col("parent"), F.expr(f"substring(name, {len(prefix) + 1})").alias("name"), F.lit(True).alias(as_)).distinct()
    rows = entries.join(yes, "path", "left").join(no, "path", "left").join(named(".backup-", "named_yes"), ["parent", "name"], "left").join(named(".no-backup-", "named_no"), ["parent", "name"], "left")
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))

    def state(of_parent):
        by_name = F.when(of_parent & is_true("named_no"), False).when(~of_parent & is_true("named_yes"), True).otherwise(of_parent)
        opened = F.col("is_dir") & ~F.col("is_symlink")
        return F.when(opened & is_true("yes"), True).when(opened & is_true("no"), False).otherwise(by_name)

    level = rows.where("parent is null").withColumn("included", state(F.lit(included))).withColumn("flips", F.col("included") != F.lit(included))
    done = level.select("path", "included", "flips")
    depth = tree.select(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    for _ in range(depth):
        above = level.where("is_dir and not is_symlink").select(F.col("path").alias("parent"), F.col("included").alias("above"))
        level = rows.join(above, "parent").withColumn("included", state(F.col("above"))).withColumn("flips", F.col("included") != F.col("above"))
        done = done.union(level.select("path", "included", "flips"))
    return done


def unmatched(tree: DataFrame) -> DataFrame:
    """Named markers whose entry is not there: warnings."""
    names = tree.select("parent", F.col("name").alias("target"))
    marks = tree.select("parent", "name", F.regexp_extract("name", r"^\.(?:no-)?backup-(.+)$", 1).alias("target")).where("target <> ''")
    return marks.join(names, ["parent", "target"], "left_anti").select("parent", "name")

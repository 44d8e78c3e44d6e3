"""Snapshot diff and rename matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut, lack
from ..functions.text import basename, parent_dir

SYMBOL_FIELDS = ("kind", "name", "line", "end_line", "qualified_name", "file_id")


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, path, old_sha256, new_sha256): added, removed and changed files by path."""
    both = old.select("path", F.col("sha256").alias("old_sha256"), F.lit(1).alias("o")).join(new.select("path", F.col("sha256").alias("new_sha256"), F.lit(1).alias("n")), "path", "full")
    op = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old_sha256").eqNullSafe(F.col("new_sha256")), "changed")
    return both.withColumn("op", op).where("op IS NOT NULL").select("op", "path", "old_sha256", "new_sha256")


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, id, before, after): a symbol has changed if one of six fields has, missing values being values."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.struct(*SYMBOL_FIELDS).alias(name))

    both = side(old, "before").join(side(new, "after"), "id", "full")
    op = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("op", op).where("op IS NOT NULL").select("op", "id", "before", "after")


def matched(removed: DataFrame, added: DataFrame, keys: list[str], id: str) -> DataFrame:
    """Keys that both sides have: (keys, from_ids, to_ids, unique), ids sorted; unique if one id is on either side."""
    a = removed.groupBy(*keys).agg(F.array_sort(F.collect_list(id)).alias("from_ids"))
    b = added.groupBy(*keys).agg(F.array_sort(F.collect_list(id)).alias("to_ids"))
    return a.join(b, keys).withColumn("unique", (F.size("from_ids") == 1) & (F.size("to_ids") == 1))


def remap(old_symbols: DataFrame, new_symbols: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """(entity, tier, reason, key, from_ids, to_ids) for removed and added symbols and files.

    Symbols: high if a qualified name was removed once and added once, else ambiguous_qualified_name. Of what no high
    match used: medium if kind, name and folder are unique on both sides, else ambiguous_kind_name_dir. Files: medium
    if the base name is, else ambiguous_basename.
    """
    paths = old_files.select(F.col("id").alias("file_id"), "path").unionByName(new_files.select(F.col("id").alias("file_id"), "path")).dropDuplicates(["file_id"])
    gone = cut(lack(old_symbols, new_symbols, ["id"]))
    come = cut(lack(new_symbols, old_symbols, ["id"]))
    high = cut(matched(gone, come, ["qualified_name"], "id"))
    first = high.select(F.lit("symbol").alias("entity"), F.when(F.col("unique"), "high").otherwise("ambiguous_qualified_name").alias("tier"), F.lit("unique_qualified_name_match").alias("reason"), F.col("qualified_name").alias("key"), "from_ids", "to_ids")
    used = high.where("unique").select(F.explode(F.concat("from_ids", "to_ids")).alias("id"))

    def placed(df: DataFrame) -> DataFrame:
        return lack(df, used, ["id"]).drop("path").join(paths, "file_id", "left").withColumn("dir", parent_dir(F.col("path")))

    medium = matched(placed(gone), placed(come), ["kind", "name", "dir"], "id")
    second = medium.select(F.lit("symbol").alias("entity"), F.when(F.col("unique"), "medium").otherwise("ambiguous_kind_name_dir").alias("tier"), F.lit("unique_kind_name_parent_dir_match").alias("reason"), F.concat_ws("|", "dir", "name", "kind").alias("key"), "from_ids", "to_ids")
    lost = lack(old_files, new_files, ["path"]).withColumn("base", basename(F.col("path")))
    seen = lack(new_files, old_files, ["path"]).withColumn("base", basename(F.col("path")))
    files = matched(lost, seen, ["base"], "id")
    third = files.select(F.lit("file").alias("entity"), F.when(F.col("unique"), "medium").otherwise("ambiguous_basename").alias("tier"), F.lit("unique_basename_match").alias("reason"), F.col("base").alias("key"), "from_ids", "to_ids")
    return first.unionByName(second).unionByName(third)

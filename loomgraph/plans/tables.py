"""The engine's relations over a data folder of business tables: graph, snapshots, overlays, vectors, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(tag: str, key: str):
    return F.concat(F.lit(f"{tag}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label, kind, language, path, ord) of regions, nations, customers, suppliers, orders and parts."""
    out = None
    for tag, table, key, label in (("R", "region", "r_regionkey", "r_name"), ("N", "nation", "n_nationkey", "n_name"), ("C", "customer", "c_custkey", "c_name"), ("S", "supplier", "s_suppkey", "s_name"), ("O", "orders", "o_orderkey", None), ("P", "part", "p_partkey", "p_name")):
        text = F.lower(F.replace(F.col(label), F.lit(" "), F.lit("_"))) if label else F.concat(F.lit("order_"), F.col(key).cast("string"))
        rows = read(spark, sf_dir, table).select(tagged(tag, key).alias("node"), text.alias("label"), F.lit("function").alias("kind"), F.lit(table).alias("language"), F.lit(None).cast("string").alias("path"), F.col(key).cast("bigint").alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, confidence): places contain places, customers and orders; orders call parts."""
    def contains(table: str, a: str, ak: str, b: str, bk: str) -> DataFrame:
        return read(spark, sf_dir, table).select(tagged(a, ak).alias("src"), tagged(b, bk).alias("dst"), F.lit("contains").alias("kind"), F.lit("resolved").alias("confidence"))

    sure = F.when(F.col("l_returnflag") == "A", "resolved").when(F.col("l_returnflag") == "N", "heuristic").otherwise("unknown")
    calls = read(spark, sf_dir, "lineitem").select(tagged("O", "l_orderkey").alias("src"), tagged("P", "l_partkey").alias("dst"), F.lit("calls").alias("kind"), sure.alias("confidence"))
    out = contains("nation", "R", "n_regionkey", "N", "n_nationkey")
    for row in (("customer", "N", "c_nationkey", "C", "c_custkey"), ("supplier", "N", "s_nationkey", "S", "s_suppkey"), ("orders", "C", "o_custkey", "O", "o_orderkey")):
        out = out.unionByName(contains(*row))
    return out.unionByName(calls)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(tagged("R", "r_regionkey").alias("node"))


def trade(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """(src, dst, kind, n): the most frequent customer nations of each supplier nation, cyclic; ties to the smaller key."""
    from pyspark.sql import Window

    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    pairs = line.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = pairs.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    order_by = Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey")
    best = counts.withColumn("nth", F.row_number().over(order_by)).where(F.col("nth") <= top)
    return best.select(tagged("N", "s_nationkey").alias("src"), tagged("N", "c_nationkey").alias("dst"), F.lit("calls").alias("kind"), "n")


def followers(spark: SparkSession, sf_dir: str, top: int = 2) -> DataFrame:
    """(src, dst, kind): for each part those that most often come next in an order, ties to the smaller name; has cycles."""
    from pyspark.sql import Window

    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tagged("P", "l_partkey").alias("src"))
    after = F.lead("src").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src"))
    counts = line.select("src", after.alias("dst")).where("dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= top).select("src", "dst", F.lit("calls").alias("kind"))


def place_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent) of regions, nations and customers."""
    n = read(spark, sf_dir, "nation").select(tagged("N", "n_nationkey").alias("node"), tagged("R", "n_regionkey").alias("parent"))
    c = read(spark, sf_dir, "customer").select(tagged("C", "c_custkey").alias("node"), tagged("N", "c_nationkey").alias("parent"))
    return regions(spark, sf_dir).select("node", F.lit(None).cast("string").alias("parent")).unionByName(n).unionByName(c)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of files (id, path, sha256) from documents: some gone, some new, some moved, some changed."""
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    old = docs.where("doc_id % 10 <> 0").select(F.concat_ws("/", "source", "lang", name).alias("path"), F.sha2("text", 256).alias("sha256"))
    folder = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("moved_"), "source")).otherwise(F.col("source"))
    text = F.when(F.col("doc_id") % 11 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 7 <> 0").select(F.concat_ws("/", folder, "lang", name).alias("path"), F.sha2(text, 256).alias("sha256"))
    return tuple(x.select(F.concat(F.lit("file:"), "path").alias("id"), "path", "sha256") for x in (old, new))


def symbol_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two snapshots of symbols and their files, from parts: (old symbols, new symbols, old files, new files)."""
    part = read(spark, sf_dir, "part")
    qual = F.concat_ws(".", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.concat(F.lit("n"), (F.col("p_partkey") % 40).cast("string")))
    base = part.select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"), qual.alias("qualified_name"), F.col("p_size").alias("line"))

    def side(rows: DataFrame, folder) -> DataFrame:
        path = F.concat_ws("/", folder, F.concat("brand", F.lit(".py")))
        rows = rows.withColumn("path", path).withColumn("name", F.substring_index("qualified_name", ".", -1))
        return rows.select(F.concat(F.lit("sym:"), "path", F.lit(":"), "qualified_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("id"), F.lit("function").alias("kind"), "name", "qualified_name", F.concat(F.lit("file:"), "path").alias("file_id"), "line", (F.col("line") + 3).alias("end_line"), "path")

    old = side(base.where("p_partkey % 10 <> 0"), F.when(F.col("p_partkey") % 6 == 1, "lib").otherwise(F.lit("src")))
    moved = base.where("p_partkey % 9 <> 0").withColumn("line", F.when(F.col("p_partkey") % 11 == 3, F.col("line") + 1).otherwise(F.col("line")))
    moved = moved.withColumn("qualified_name", F.when(F.col("p_partkey") % 13 == 5, F.concat(F.lit("renamed."), "qualified_name")).otherwise(F.col("qualified_name")))
    new = side(moved, F.when(F.col("p_partkey") % 4 == 1, "lib").otherwise(F.lit("src")))
    files = lambda s: s.select(F.col("file_id").alias("id"), "path").distinct()
    return old, new, files(old), files(new)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

"""Name resolution as joins: every rule that a per-call search would scan for is an equi-join on an exploded key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import in_order, one_per
from ..functions.text import leaf_of, scope_prefixes

#: Method names too general to be matched by their last segment.
GENERIC_METHODS = (
    "get", "set", "update", "pop", "popitem", "keys", "values", "items", "setdefault",
    "append", "extend", "insert", "remove", "index", "count", "clear", "copy", "sort",
    "add", "discard", "union", "intersection", "difference",
    "load", "loads", "dump", "dumps", "save", "read", "write", "close", "open",
    "encode", "decode", "strip", "split", "join", "format", "replace", "startswith",
    "endswith", "lower", "upper", "find", "rfind",
    "send", "recv", "start", "stop", "run", "execute", "call", "apply",
    "next", "iter", "__init__", "__enter__", "__exit__",
)


def callable_symbols(symbols: DataFrame) -> DataFrame:
    """Functions with a name; of symbols with one qualified name the last (by ord)."""
    named = symbols.where("kind IN ('function', 'async_function') AND coalesce(qualified_name, '') <> ''")
    return one_per(named, ["qualified_name"], F.desc("ord"))


def reexports(symbols: DataFrame) -> DataFrame:
    """(pkg, leaf, qualified_name) of names that exactly one symbol below a package ends with."""
    parts = F.split("qualified_name", r"\.")
    below = symbols.select("qualified_name", leaf_of(F.col("qualified_name")).alias("leaf"), F.explode(F.filter(scope_prefixes(F.col("qualified_name")), lambda p: p != F.col("qualified_name"))).alias("pkg")).where(F.size(parts) > 1)
    return below.groupBy("pkg", "leaf").agg(F.count("*").alias("n"), F.min("qualified_name").alias("qualified_name")).where("n = 1").drop("n")


def resolve_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` (call, name, scope, target) with ``resolved``, the qualified name that a bare name stands for, or null.

    A name that is imported (target not null) means its target: exactly, else by re-export, else nothing. Another name
    is looked up in the scopes from the innermost outwards, class scopes and the module included.
    """
    known = symbols.select(F.col("qualified_name").alias("found")).distinct()
    imported = calls.where("target IS NOT NULL").join(known, F.col("target") == F.col("found"), "left")
    again = reexports(symbols.select("qualified_name").distinct()).withColumnRenamed("qualified_name", "unique")
    pkg = F.regexp_extract("target", r"^(.*)\.[^.]*$", 1)
    imported = imported.join(again, (pkg == F.col("pkg")) & (leaf_of(F.col("target")) == F.col("leaf")), "left")
    imported = imported.select(*calls.columns, F.coalesce("found", "unique").alias("resolved"))
    tries = calls.where("target IS NULL").select(*calls.columns, F.posexplode(scope_prefixes(F.col("scope"))).alias("rank", "prefix"))
    tries = tries.withColumn("candidate", F.when(F.col("prefix") == "", F.col("name")).otherwise(F.concat_ws(".", "prefix", "name")))
    hits = tries.join(known, F.col("candidate") == F.col("found"), "left").groupBy("call").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("rank"))).alias("resolved"))
    return imported.unionByName(calls.where("target IS NULL").join(hits, "call", "left").select(*calls.columns, "resolved"))


def unique_suffix(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` (call, form, name, class) with ``resolved``.

    form ``bare``: the name, if known. ``self``: the class's method, if known; else, and for form ``attr``: the only known name
    that is it or ends with it, unless the name is too general. Other forms (chained receivers) don't resolve.
    """
    known = symbols.select("qualified_name").distinct()
    ends = known.groupBy(leaf_of(F.col("qualified_name")).alias("leaf")).agg(F.count("*").alias("n"), F.min("qualified_name").alias("unique")).where("n = 1").drop("n")
    exact = F.when(F.col("form") == "bare", F.col("name")).when(F.col("form") == "self", F.concat_ws(".", "class", "name"))
    out = calls.withColumn("__exact", exact).join(known.withColumnRenamed("qualified_name", "__found"), F.col("__exact") == F.col("__found"), "left")
    general = F.col("name").isin(*GENERIC_METHODS)
    out = out.join(ends, (F.col("name") == F.col("leaf")) & F.col("form").isin("self", "attr") & ~general, "left")
    return out.select(*calls.columns, F.coalesce("__found", "unique").alias("resolved"))


def first_suffix(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` (call, target) with ``resolved``: the target itself, else the first symbol (by ord) with its last segment."""
    known = symbols.select(F.col("qualified_name").alias("found")).distinct()
    first = symbols.groupBy(leaf_of(F.col("qualified_name")).alias("leaf")).agg(F.min_by("qualified_name", "ord").alias("first"))
    out = calls.join(known, F.col("target") == F.col("found"), "left").join(first, leaf_of(F.col("target")) == F.col("leaf"), "left")
    return out.select(*calls.columns, F.coalesce("found", "first").alias("resolved"))


def resolve_script_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` (call, name, scope, module, target) with ``resolved``; symbols (qualified_name, ord).

    An imported name means its target, else the first symbol with the target's last segment, even if it is another package's.
    Another name is looked up in the scopes from the innermost out to the module, never beyond it.
    """
    imported = first_suffix(calls.where("target IS NOT NULL"), symbols)
    known = symbols.select(F.col("qualified_name").alias("found")).distinct()
    own = calls.where("target IS NULL")
    tries = own.select("call", "name", "module", F.posexplode(scope_prefixes(F.col("scope"))).alias("rank", "prefix"))
    tries = tries.where((F.col("prefix") == F.col("module")) | F.startswith("prefix", F.concat("module", F.lit("."))) | (F.col("module") == ""))
    hits = tries.withColumn("found", F.when(F.col("prefix") == "", F.col("name")).otherwise(F.concat_ws(".", "prefix", "name"))).join(known, "found").groupBy("call").agg(F.min_by("found", "rank").alias("resolved"))
    return imported.unionByName(own.join(hits, "call", "left").select(*calls.columns, "resolved"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst) from a function to those defined in it; the parent must be a function, so methods have none."""
    names = symbols.select("qualified_name").distinct()
    parent = F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1)
    return names.select(parent.alias("src"), F.col("qualified_name").alias("dst")).where("src <> ''").join(names.withColumnRenamed("qualified_name", "src"), "src", "left_semi").distinct()


def classify_calls(calls: DataFrame, resolved: str = "resolved") -> DataFrame:
    """``calls`` with ``confidence``: resolved, unknown, or null for a call of a builtin or of another form.

    Needs form (name or attribute), name and is_builtin.
    """
    kind = F.when((F.col("form") == "name") & F.col(resolved).isNotNull(), "resolved").when((F.col("form") == "name") & ~F.col("is_builtin"), "unknown").when(F.col("form") == "attribute", "unknown")
    return calls.withColumn("confidence", kind)


def numbered_edges(contains: DataFrame, resolved: DataFrame, unknown: DataFrame) -> DataFrame:
    """(id, src, dst, kind, confidence, line, callee) in the order of an export: contains, then resolved calls, both
    by ends and without repetition, then unknown calls by caller, line and callee, each as often as it occurs."""
    a = contains.select("src", "dst").distinct().select(F.lit(0).alias("part"), "src", "dst", F.lit("contains").alias("kind"), F.lit("resolved").alias("confidence"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("callee"), F.lit(0).cast("bigint").alias("visit"))
    b = resolved.select("src", "dst").distinct().select(F.lit(1).alias("part"), "src", "dst", F.lit("calls").alias("kind"), F.lit("resolved").alias("confidence"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("callee"), F.lit(0).cast("bigint").alias("visit"))
    c = unknown.select(F.lit(2).alias("part"), "src", "dst", F.lit("calls").alias("kind"), F.lit("unknown").alias("confidence"), F.col("line").cast("int").alias("line"), "callee", F.col("visit").cast("bigint").alias("visit"))
    return in_order(a.unionByName(b).unionByName(c), "part", "src", F.when(F.col("part") < 2, F.col("dst")), "line", "callee", "visit").select(F.concat(F.lit("e:"), F.col("nth").cast("string")).alias("id"), "src", "dst", "kind", "confidence", "line", "callee")


def last_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of repeated keys the last row."""
    return one_per(rows, keys, *(F.desc(c) for c in order))


def collisions(functions: DataFrame) -> DataFrame:
    """(qname, n_files) of names that several files define."""
    return functions.groupBy("qname").agg(F.countDistinct("file").alias("n_files")).where("n_files > 1")

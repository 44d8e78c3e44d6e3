"""Overlays in long form (scope, id, key, value): migration, merge, orphans, generation."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import cut, have, lack
from ..functions.text import parents, structural_name
from .graph import closure

#: The five maps of an overlay document, and the id of its root entry.
SCOPES = ("by_symbol_id", "by_file_id", "by_directory_id", "by_root_id", "by_flow_node_id")
ROOT_ID = "raw-root"


def migrate(overlay: DataFrame, remapped: DataFrame, medium_symbols: bool = False) -> tuple[DataFrame, DataFrame]:
    """The overlay with entries moved along unique matches, and a report (kind, action, from_id, to_id, confidence).

    Symbols move along high matches, along medium ones only if asked; files always along medium ones. If the target has
    an entry, the moved one's values win unless they are missing or empty.
    """
    tiers = ["high", "medium"] if medium_symbols else ["high"]
    unique = remapped.where(((F.col("entity") == "symbol") & F.col("tier").isin(*tiers)) | ((F.col("entity") == "file") & (F.col("tier") == "medium")))
    moves = unique.select(F.when(F.col("entity") == "symbol", "by_symbol_id").otherwise("by_file_id").alias("scope"), F.col("from_ids")[0].alias("id"), F.col("to_ids")[0].alias("to_id"), F.col("tier").alias("confidence"), F.col("entity").alias("kind"))
    entries = overlay.select("scope", "id").distinct()
    there = entries.select("scope", F.col("id").alias("to_id"), F.lit(True).alias("merge"))
    report = moves.join(entries.withColumn("has", F.lit(True)), ["scope", "id"], "left").join(there, ["scope", "to_id"], "left")
    action = F.when(F.col("has").isNull(), "skipped").when(F.col("merge"), "merged").otherwise("moved")
    report = report.select("kind", action.alias("action"), F.col("id").alias("from_id"), "to_id", "confidence")
    moved = overlay.join(moves.select("scope", "id", "to_id"), ["scope", "id"], "left").select("scope", F.coalesce("to_id", "id").alias("id"), "key", "value", F.col("to_id").isNotNull().alias("moved"))
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    best = F.coalesce(F.max_by("value", F.when(filled, F.when(F.col("moved"), 2).otherwise(1))), F.max_by("value", F.col("moved").cast("int")))
    return moved.groupBy("scope", "id", "key").agg(best.alias("value")), report


def merge_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Field by field, the delta wins, even with an empty value."""
    d = delta.select("scope", "id", "key", F.col("value").alias("__new"), F.lit(True).alias("__has"))
    return base.join(d, ["scope", "id", "key"], "full").select("scope", "id", "key", F.when(F.col("__has"), F.col("__new")).otherwise(F.col("value")).alias("value"))


def directories(files: DataFrame) -> DataFrame:
    """O3: (id) of all folders above files; files at the root add none."""
    return files.select(F.explode(parents(F.col("path"))).alias("dir")).distinct().select(F.concat(F.lit("dir:"), "dir").alias("id"))


def orphans(overlay: DataFrame, symbols: DataFrame, files: DataFrame, flow_nodes: DataFrame | None = None) -> DataFrame:
    """(scope, id) of entries whose id isn't there. Flow entries are only checked against given nodes."""
    ids = overlay.select("scope", "id").distinct()
    valid = {"by_symbol_id": symbols.select("id"), "by_file_id": files.select("id"), "by_directory_id": directories(files)}
    out = ids.where((F.col("scope") == "by_root_id") & (F.col("id") != ROOT_ID))
    for scope, known in valid.items():
        out = out.unionByName(lack(ids.where(F.col("scope") == scope), known, ["id"]))
    if flow_nodes is not None:
        out = out.unionByName(lack(ids.where("scope = 'by_flow_node_id'"), flow_nodes.select(F.col("node").alias("id")), ["id"]))
    return out


def use_cases(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(id, displayName, use_case, reachable_node_count): a row for each entrypoint with what it reaches,
    itself included, and one with a name alone for every other node that one of them reaches."""
    pairs = cut(closure(entrypoints, edges))
    counts = pairs.groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("reachable_node_count"))
    names = nodes.select("node", structural_name(F.col("label")).alias("displayName"))
    first = counts.join(names, "node", "left").select(F.col("node").alias("id"), "displayName", F.lit(True).alias("use_case"), "reachable_node_count")
    rest = lack(pairs.select("node").distinct(), entrypoints, ["node"]).join(names, "node").select(F.col("node").alias("id"), "displayName", F.lit(None).cast("boolean").alias("use_case"), F.lit(None).cast("bigint").alias("reachable_node_count"))
    return first.unionByName(rest)


def prompts(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, most: int = 20) -> DataFrame:
    """(id, prompt): an entrypoint's label and the labels of the first ``most`` reachable nodes by id; every task passes on no
    more than that many of an entrypoint."""
    pairs = closure(entrypoints, edges).join(nodes.select("node", "label"), "node")
    first = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("nth") <= most)
    lists = first.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("near"))
    named = lists.join(nodes.select(F.col("node").alias("seed"), "label"), "seed")
    return named.select(F.col("seed").alias("id"), F.concat(F.lit("Name the use case that starts at "), "label", F.lit(". It reaches: "), F.array_join(F.transform("near", lambda x: x["label"]), ", "), F.lit(". Answer with JSON: displayName, userDescription.")).alias("prompt"))


def parse_label(text: str) -> dict | None:
    """displayName and userDescription of an answer, fences stripped; None without both."""
    inner = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    try:
        doc = json.loads((inner[1] if inner else text).strip())
    except ValueError:
        return None
    if not isinstance(doc, dict) or "displayName" not in doc or "userDescription" not in doc:
        return None
    return {k: str(doc[k]) for k in ("displayName", "userDescription")}


def label_entries(rows: DataFrame, provider) -> DataFrame:
    """``rows`` (id, prompt) with displayName and userDescription from ``provider(prompt) -> str``, null where it fails.

    The provider is the caller's; there is none by default, and structural names stay where it has no answer.
    """
    import pandas as pd

    def ask(batches):
        for pdf in batches:
            found = []
            for p in pdf["prompt"]:
                try:
                    found.append(parse_label(provider(p)) or {})
                except Exception:  # whatever a network does, the structural name stays
                    found.append({})
            yield pd.DataFrame({"id": pdf["id"], "displayName": [f.get("displayName") for f in found], "userDescription": [f.get("userDescription") for f in found]})

    return rows.select("id", "prompt").mapInPandas(ask, "id string, displayName string, userDescription string")


def known_labels(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries of nodes that exist."""
    return have(entries, nodes.select(F.col("node").alias("id")), ["id"])

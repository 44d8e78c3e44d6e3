"""Command line: index, execution-ir, diff, orphans, overlay-migrate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analytics, diff, overlay
from .plans import ir
from .sources import documents


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph", description="Code graphs of source repositories")
    sub = top.add_subparsers(dest="verb", required=True)
    for verb in ("index", "execution-ir"):
        p = sub.add_parser(verb)
        p.add_argument("path")
        p.add_argument("--src-root", action="append", dest="starts")
        p.add_argument("--diagnostics", action="store_true")
        p.add_argument("-o", "--out")
    p = sub.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("-o", "--out")
    p = sub.add_parser("orphans")
    p.add_argument("raw")
    p.add_argument("overlay")
    p.add_argument("-o", "--out")
    p = sub.add_parser("overlay-migrate")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("overlay")
    p.add_argument("-o", "--out")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--include-medium", action="store_true")
    return top


def diff_document(old: dict, new: dict, spark: SparkSession) -> tuple[dict, object]:
    """The diff of two RAW documents, and its rename matches as rows."""
    (os, of), (ns, nf) = (documents.snapshot_frames(spark, d) for d in (old, new))
    matches = diff.remap(os, ns, of, nf)
    files, symbols = diff.diff_files(of, nf).collect(), diff.diff_symbols(os, ns).collect()
    pick = lambda rows, op, key: sorted(r[key] for r in rows if r["op"] == op)
    doc = {
        "schema_version": 0,
        "files": {"added": pick(files, "added", "path"), "removed": pick(files, "removed", "path"), "changed": [{"path": r["path"], "old_sha256": r["old_sha256"], "new_sha256": r["new_sha256"]} for r in sorted(files, key=lambda r: r["path"]) if r["op"] == "changed"]},
        "symbols": {"added": pick(symbols, "added", "id"), "removed": pick(symbols, "removed", "id"), "changed": [{"id": r["id"], "before": r["before"].asDict(), "after": r["after"].asDict()} for r in sorted(symbols, key=lambda r: r["id"]) if r["op"] == "changed"]},
        "remap": [r.asDict() for r in matches.orderBy("entity", "tier", "key").collect()],
    }
    return doc, matches


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()

    def put(doc: dict) -> None:
        text = documents.write_json(doc, args.out)
        if args.out is None:
            sys.stdout.write(text)

    if args.verb in ("index", "execution-ir"):
        raw = ir.index(spark, args.path, args.starts)
        doc = ir.raw_document(raw)
        if args.diagnostics and (report := documents.type_checker_report(args.path)):
            doc = documents.with_diagnostics(doc, analytics.diagnostics_by_path(documents.diagnostic_rows(spark, report, args.path)))
        put(doc if args.verb == "index" else ir.graph_document(raw, ir.build_graph(raw)))
        return 0
    if args.verb == "diff":
        put(diff_document(documents.load_json(args.old), documents.load_json(args.new), spark)[0])
        return 0
    if args.verb == "orphans":
        symbols, files = documents.snapshot_frames(spark, documents.load_json(args.raw))
        rows = overlay.orphans(documents.overlay_rows(spark, documents.load_overlay(args.overlay)), symbols, files).orderBy("scope", "id").collect()
        lists = {s: [r["id"] for r in rows if r["scope"] == s] for s in overlay.SCOPES}
        put({"schema_version": 0, "raw_path": args.raw, "overlay_path": args.overlay, "orphan_count": len(rows)} | lists)
        return 1 if rows else 0
    _, matches = diff_document(documents.load_json(args.old), documents.load_json(args.new), spark)
    before = documents.load_overlay(args.overlay)
    moved, report = overlay.migrate(documents.overlay_rows(spark, before), matches, args.include_medium)
    doc, log = documents.overlay_document(moved, before.get("schema_version", 0)), [r.asDict() for r in report.orderBy(F.col("kind"), "from_id").collect()]
    if args.dry_run:
        sys.stdout.write(documents.dump_json({"schema_version": 0, "report": log, "overlay": doc}))
        return 0
    if not args.out:
        sys.stderr.write("overlay-migrate needs -o or --dry-run\n")
        return 1
    documents.write_json(doc, args.out)
    sys.stderr.write(documents.dump_json(log))
    return 0


if __name__ == "__main__":
    sys.exit(main())

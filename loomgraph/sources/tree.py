"""Source trees as tables (S1-S5): a Python data source, since Spark's file sources hide names that begin with _ or a dot."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are never indexed, by exact name.
SKIP_DIR_NAMES = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", "node_modules", "dist", "build", ".egg-info")
SCRIPT_ENDS = (".ts", ".tsx", ".js", ".mjs", ".jsx")
FILES_PER_TASK = 64


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["path"])
        self.ends = tuple(options.get("ends", ".py").split(","))
        self.skip = frozenset(x for x in options.get("skip", "").split(",") if x)
        self.starts = options.get("starts", ".").split(",")

    def partitions(self) -> list[_Files]:
        found = []
        for start in self.starts:
            top = os.path.join(self.root, start)
            for folder, _, names in os.walk(top):
                found += [p for n in names if n.endswith(self.ends) and not self.skip.intersection((p := os.path.realpath(os.path.join(folder, n))).split(os.sep))]
        found = list(enumerate(sorted(p for p in found if p.startswith(self.root + os.sep))))
        return [_Files(found[i : i + FILES_PER_TASK]) for i in range(0, len(found), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for at, file in partition.files:
            with open(file, "rb") as f:
                yield at, os.path.relpath(file, self.root).replace(os.sep, "/"), f.read()


class SourceTree(DataSource):
    """Format ``srctree``: (ord, path, content) of the files below ``path`` whose names end with one of ``ends``.

    Options: ends and skip (comma-separated), starts (folders below the path; files below two of them come twice).
    Missing folders hold nothing. The tree must be readable at the same place by the driver and all workers.
    """

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return "ord int, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def _scan(spark: SparkSession, root: str, ends: tuple[str, ...], skip: tuple[str, ...], starts: list[str]) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("srctree").option("ends", ",".join(ends)).option("skip", ",".join(skip)).option("starts", ",".join(starts)).load(str(root))


def python_starts(root: str | Path) -> list[str]:
    """``src`` if there is one, else the root."""
    return ["src"] if (Path(root) / "src").is_dir() else ["."]


def python_files(spark: SparkSession, root: str, starts: list[str] | None = None) -> DataFrame:
    """S3: Python files; folders that tools fill are skipped."""
    return _scan(spark, root, (".py",), SKIP_DIR_NAMES, python_starts(root) if starts is None else starts)


def script_files(spark: SparkSession, root: str, starts: list[str] | None = None) -> DataFrame:
    """TypeScript and JavaScript files, in all folders."""
    return _scan(spark, root, SCRIPT_ENDS, (), starts or python_starts(root))


def language_of(root: str | Path) -> str:
    """``typescript`` if there are scripts outside hidden folders and no Python file at all, else ``python``."""
    scripts = any(p.suffix in SCRIPT_ENDS and not any(x.startswith(".") for x in p.resolve().parts) for p in Path(root).rglob("*") if p.is_file())
    return "typescript" if scripts and next(Path(root).rglob("*.py"), None) is None else "python"


def hashed(files: DataFrame) -> DataFrame:
    """(ord, path, sha256, content)."""
    return files.select("ord", "path", F.sha2("content", 256).alias("sha256"), "content")


def load_config(root: str | Path, name: str) -> dict:
    """A TOML file as a dict; missing or invalid files are empty."""
    try:
        return tomllib.loads((Path(root) / name).read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return {}

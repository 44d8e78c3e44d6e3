"""Scalar functions over names, paths and snippets: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def structural_name(label: Column) -> Column:
    """a readable name from the last dotted segment; all-lower words are capitalised, others stay (HTTP)."""
    leaf = F.replace(F.substring_index(label, ".", -1), F.lit("_"), F.lit(" "))
    spaced = F.regexp_replace(F.regexp_replace(leaf, "([A-Z])([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.lower(w) == w) & (F.upper(w) != w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)), " ")


def leaf_of(name: Column) -> Column:
    """the last dotted segment."""
    return F.substring_index(name, ".", -1)


def first_line(text: Column) -> Column:
    """head of a docstring."""
    return F.split(text, "\n")[0]


def basename(path: Column) -> Column:
    """F8: the last component of a path."""
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """F8: the folder of a path; ``.`` for a file at the root, empty for an unknown path."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def python_qualname(path: Column) -> Column:
    """dotted module name of a Python file: no leading ``src``, no ``.py``, no trailing ``__init__``."""
    inner = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.py$", "")
    return F.replace(F.regexp_replace(inner, "(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def script_qualname(path: Column) -> Column:
    """F9 for TypeScript and JavaScript: no leading ``src``, no extension, no trailing ``index`` below a folder."""
    inner = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.(ts|tsx|js|mjs|jsx)$", "")
    return F.replace(F.regexp_replace(inner, "/index$", ""), F.lit("/"), F.lit("."))


def import_base(module: Column, level: Column, current: Column) -> Column:
    """The module that a relative import starts from; empty if it climbs above the top."""
    parts = F.split(current, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - level)), ".")
    module = F.coalesce(module, F.lit(""))
    return F.when(level == 0, module).when(level > F.size(parts), F.lit("")).when(base == "", module).when(module == "", base).otherwise(F.concat_ws(".", base, module))


def snippet(text: Column) -> Column:
    """one line, at most 200 characters, the last three of a longer one being dots."""
    line = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(line) > 200, F.concat(F.substring(line, 1, 197), F.lit("..."))).otherwise(line)


def fenced(text: Column) -> Column:
    """the content of the first fenced block, or the text."""
    found = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(found != "", found).otherwise(text))


def parents(path: Column) -> Column:
    """O3: all proper ancestor folders of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def scope_prefixes(name: Column) -> Column:
    """A dotted name and its ancestors, innermost first, without the empty one."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "."))


def cosine(a: Column, b: Column) -> Column:
    """cosine of two arrays in double precision; 0 if one has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit(":"), name)


def function_id(name: Column, language: str = "py") -> Column:
    return F.concat(F.lit(f"{language}:fn:"), name)

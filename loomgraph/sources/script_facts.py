"""Facts of TypeScript and JavaScript files in one pass over tokens (S9, S10, R9, R11): symbols, imports, and calls with what their name
is bound to.

There is no grammar here: a scanner tells strings, templates, regular expressions and comments from code and pairs brackets,
and a reader follows statements over these pairs. Functions are declared functions, constants and variables that hold
a function, and methods; classes, generators that are declared, signatures and nameless functions are none. A function in a block
of its own (``if``, a callback) is no symbol; what it calls belongs to the function around it. Parameter defaults of methods and
fields of classes aren't read for calls. A file whose brackets don't pair is kept with an error and without symbols.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "ord int, path string, sha256 string, parse_ok boolean, error string,"
    "symbols array<struct<kind: string, name: string, qualified_name: string, line: int, end_line: int, exported: boolean>>,"
    "imports array<struct<kind: string, from_module: string, module: string, line: int>>,"
    "calls array<struct<caller: string, scope: string, module: string, form: string, name: string, target: string, expression: string, line: int>>"
)
ENDS = (".ts", ".tsx", ".js", ".mjs", ".jsx")
_PIECE = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/|^\#![^\n]*)|(?P<name>[\#@]?[^\W\d][\w$]*|\$[\w$]*|[\#@]\w+)|(?P<number>\d[\w.]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<mark>=>|\?\.(?!\d)|\.\.\.|\+\+|--|===?|!==?|[-+*/%&|^<>]=|&&|\|\||\?\?|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Fixed values of the language: words before an expression, and words that are followed by brackets without being called.
_BEFORE = frozenset("return typeof instanceof in of new delete void throw case do else await yield extends default".split())
_UNCALLED = frozenset("if for while switch catch function return typeof instanceof in of new delete void throw case do else await yield with extends".split())
_MODIFIERS = frozenset("public private protected static async get set readonly override abstract declare accessor *".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    partner: int = -1


@dataclass
class Source:
    text: str
    tokens: list[Token] = field(default_factory=list)

    def line_at(self, place: int) -> int:
        return self.text.count("\n", 0, place) + 1


def scan(text: str) -> Source:
    """Tokens with paired brackets; raises ValueError where something is open at the end."""
    out, at, line, open_ = Source(text), 0, 1, []
    tokens = out.tokens

    def add(kind: str, end: int) -> None:
        nonlocal at, line
        tokens.append(Token(kind, text[at:end], at, end, line))
        line += text.count("\n", at, end)
        at = end

    while at < len(text):
        last = tokens[-1] if tokens else None
        if text[at] == "`" or text[at] == "}" and open_ and tokens[open_[-1]].kind == "template":
            inner = at + 1
            while inner < len(text) and text[inner] != "`" and not text.startswith("${", inner):
                inner += 2 if text[inner] == "\\" else 1
            if inner >= len(text):
                raise ValueError(f"line {line}: a template isn't closed")
            begun = None
            if text[at] == "}":
                begun = open_.pop()
            more = text.startswith("${", inner)
            add("template", inner + (2 if more else 1))
            if begun is not None:
                tokens[begun].partner, tokens[-1].partner = len(tokens) - 1, begun
            if more:
                open_.append(len(tokens) - 1)
            continue
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (last is None or last.kind == "mark" and last.text not in (")", "]", "}") or last.kind == "name" and last.text in _BEFORE) and (m := _REGEX.match(text, at)):
            add("string", m.end())
            continue
        m = _PIECE.match(text, at)
        if m.lastgroup == "space":
            line += m[0].count("\n")
            at = m.end()
            continue
        if m.lastgroup == "mark" and text.startswith("/*", at):
            raise ValueError(f"line {line}: a comment isn't closed")
        add(m.lastgroup, m.end())
        here, mark = len(tokens) - 1, m[0]
        if mark in ("(", "[", "{"):
            open_.append(here)
        elif mark in _PAIRS and m.lastgroup == "mark":
            if not open_ or tokens[open_[-1]].text != _PAIRS[mark]:
                raise ValueError(f"line {line}: unexpected {mark}")
            begun = open_.pop()
            tokens[begun].partner, tokens[here].partner = here, begun
    if open_:
        raise ValueError(f"line {tokens[open_[-1]].line}: {tokens[open_[-1]].text} isn't closed")
    return out


def module_name(path: str) -> str:
    """no leading ``src``, no extension, no trailing ``index`` below a folder."""
    parts = path.split("/")
    parts = parts[1:] if parts[0] == "src" else parts
    if not parts:
        return ""
    end = next((e for e in ENDS if parts[-1].endswith(e)), "")
    parts[-1] = parts[-1].removesuffix(end)
    return ".".join(parts[:-1] if parts[-1] == "index" and len(parts) > 1 else parts)


class Reader:
    """Symbols and calls of one file."""

    def __init__(self, path: str, source: Source) -> None:
        self.module, self.source, self.t = module_name(path), source, source.tokens
        self.symbols, self.imports, self.calls = [], [], []
        self.names: dict[str, str] = {}
        self.spans: list[tuple[int, int, list[str]]] = []  # bodies of functions by tokens, with their scope
        self.statements(0, len(self.t), [], True)
        known = {s["qualified_name"] for s in self.symbols}
        self.called(known)

    # tokens

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in ("name", "mark") and self.t[i].text in texts

    def close(self, i: int) -> int:
        """The end of a bracket that begins at i."""
        return self.t[i].partner

    def after_type(self, i: int, *stops: str) -> int:
        """From a type annotation's colon to the first of the stops outside brackets; an arrow of a function type doesn't stop it."""
        i += 1
        while i < len(self.t) and not self.is_(i, *stops):
            if self.t[i].partner > i:
                # the braces of an object type follow a colon or an operator, those of a body don't
                i = self.t[i].partner
            i += 1
        return i

    def body_of(self, i: int) -> int:
        """The opening brace of a body whose parameters begin at or after i, or -1 (a signature)."""
        while i < len(self.t) and not self.is_(i, "(", "{", ";"):
            i += 1
        if not self.is_(i, "("):
            return -1
        i = self.close(i) + 1
        if self.is_(i, ":"):
            i += 1
            while i < len(self.t) and not self.is_(i, ";", "="):
                if self.is_(i, "{") and not self.is_(i - 1, ":", "|", "&", "=>", "<", ","):
                    return i
                i = self.t[i].partner + 1 if self.t[i].partner > i else i + 1
            return -1
        return i if self.is_(i, "{") else -1

    # statements

    def statements(self, low: int, high: int, scope: list[str], top: bool) -> None:
        """What is declared directly between two tokens."""
        i, fresh = low, True
        while i < high:
            exported = False
            if fresh and self.is_(i, "export"):
                exported, i = top, i + 1
                while self.is_(i, "default", "declare"):
                    i += 1
            start = i
            if fresh and self.is_(i, "async") and self.is_(i + 1, "function"):
                i += 1
            if fresh and top and self.is_(i, "import") and not self.is_(i + 1, "(", "."):
                i = self.imported(i)
            elif fresh and self.is_(i, "function") and i + 1 < high and self.t[i + 1].kind == "name":
                i = self.function(self.t[i + 1].text, start, i + 2, scope, exported)
            elif fresh and self.is_(i, "class") and i + 1 < high and self.t[i + 1].kind == "name":
                i = self.class_(i, scope)
            elif fresh and self.is_(i, "const", "let", "var") and i + 1 < high and self.t[i + 1].kind in ("name", "mark"):
                i = self.variables(i + 1, high, scope, exported)
            else:
                i = self.t[i].partner + 1 if self.t[i].partner > i else i + 1
            last = self.t[i - 1] if i > low else None
            fresh = last is not None and (last.text in (";", "}") and last.kind == "mark" or i < high and self.t[i].line > last.line and not (last.kind == "mark" and last.text not in (")", "]")) and not (self.t[i].kind == "mark" and self.t[i].text not in ("@",)))

    def imported(self, i: int) -> int:
        begin, names, whole = i, [], None
        i += 1
        if self.is_(i, "type") and not self.is_(i + 1, "from", ","):
            i += 1
        if i < len(self.t) and self.t[i].kind == "name" and not self.is_(i, "from"):
            whole, i = self.t[i].text, i + 1
        while i < len(self.t) and self.t[i].kind != "string" and not self.is_(i, ";"):
            if self.is_(i, "{"):
                part: list[str] = []
                for t in [*self.t[i + 1 : self.close(i)], Token("mark", ",", 0, 0, 0)]:
                    if t.text == ",":
                        part = part[1:] if len(part) in (2, 4) and part[0] == "type" else part
                        if part:
                            names.append((part[0], part[2] if len(part) == 3 and part[1] == "as" else part[0]))
                        part = []
                    else:
                        part.append(t.text)
                i = self.close(i)
            i += 1
        if i < len(self.t) and self.t[i].kind == "string":
            module = self.t[i].text.strip("\"'")
            self.imports.append({"kind": "import_from", "from_module": self.module, "module": module, "line": self.t[begin].line})
            if whole:
                self.names[whole] = module
            self.names.update({local: f"{module}.{name}" for name, local in names})
            i += 1
        return i

    def symbol(self, name: str, first: int, last: int, scope: list[str], exported: bool) -> None:
        qualified = ".".join([*([self.module] if self.module else []), *scope, name])
        end = self.t[last]
        self.symbols.append({"kind": "function", "name": name, "qualified_name": qualified, "line": self.t[first].line, "end_line": end.line + end.text.count("\n"), "exported": exported or None})

    def function(self, name: str, first: int, i: int, scope: list[str], exported: bool) -> int:
        body = self.body_of(i)
        if body < 0:
            return i
        end = self.close(body)
        self.symbol(name, first, end, scope, exported)
        self.spans.append((i, end, [*scope, name]))
        self.statements(body + 1, end, [*scope, name], False)
        return end + 1

    def variables(self, i: int, high: int, scope: list[str], exported: bool) -> int:
        """Declarators; a name that holds a function is a symbol."""
        while i < high:
            name = self.t[i].text if self.t[i].kind == "name" else None
            i = self.t[i].partner + 1 if self.t[i].partner > i else i + 1
            if self.is_(i, ":"):
                i = self.after_type(i, "=", ";", ",")
            if not self.is_(i, "="):
                return i
            i = self.value(name, i + 1, high, scope, exported)
            if not self.is_(i, ","):
                return i
            i += 1
        return i

    def value(self, name: str | None, i: int, high: int, scope: list[str], exported: bool) -> int:
        """One initial value, up to the comma or the end of its declaration."""
        first = i
        at = i + 1 if self.is_(i, "async") else i
        body = arrow = -1
        if self.is_(at, "function"):
            body = self.body_of(at + 1)
        else:
            j = at
            if self.is_(j, "<"):
                while j < high and not self.is_(j, "("):
                    j += 1
            if self.is_(j, "("):
                j = self.close(j) + 1
                if self.is_(j, ":"):
                    j = self.after_type(j, "=>", ";")
                arrow = j if self.is_(j, "=>") else -1
            elif j < high and self.t[j].kind == "name" and self.is_(j + 1, "=>"):
                arrow = j + 1
            if arrow >= 0 and self.is_(arrow + 1, "{"):
                body = arrow + 1
        # only a value that is nothing but the function counts; what follows a body is a call of it or an operator
        end = self.close(body) if body >= 0 else self.until(arrow + 1 if arrow >= 0 else i, high) - 1
        alone = body < 0 or not self.is_(end + 1, "(", ".", "?.", "[")
        if name is not None and (body >= 0 or arrow >= 0) and alone:
            self.symbol(name, first, end, scope, exported)
            self.spans.append((first, end, [*scope, name]))
            if body >= 0:
                self.statements(body + 1, end, [*scope, name], False)
        return self.until(end + 1, high) if body >= 0 else end + 1

    def until(self, i: int, high: int) -> int:
        """The end of an expression: a comma or semicolon outside brackets, or a line that begins anew."""
        begin = i
        while i < high and not self.is_(i, ",", ";"):
            if i > begin and self.t[i].line > self.t[i - 1].line and self.t[i].kind == "name" and not (self.t[i - 1].kind == "mark" and self.t[i - 1].text not in (")", "]", "}")) and self.t[i].text not in ("in", "of", "instanceof", "as", "satisfies"):
                return i
            i = self.t[i].partner + 1 if self.t[i].partner > i else i + 1
        return i

    def class_(self, i: int, scope: list[str]) -> int:
        name = self.t[i + 1].text
        abstract = self.is_(i - 1, "abstract")
        i += 2
        while i < len(self.t) and not self.is_(i, "{"):
            i = self.t[i].partner + 1 if self.t[i].partner > i else i + 1
        if i >= len(self.t):
            return i
        end, i = self.close(i), i + 1
        self.spans.append((i, end, None) if not abstract else (i, i, []))
        while i < end and not abstract:
            first = i
            while self.is_(i, *_MODIFIERS) and not self.is_(i + 1, "(", "=", ";", ":", "?", "!"):
                i += 1
            member = self.t[i]
            after = member.partner + 1 if member.partner > i else i + 1
            label = self.source.text[member.start : self.t[after - 1].end]
            while self.is_(after, "?", "!"):
                after += 1
            if self.is_(after, "<"):
                while after < end and not self.is_(after, "("):
                    after += 1
            if member.kind in ("name", "string", "number") or member.text == "[":
                if self.is_(after, "(") and not member.text.startswith("@"):
                    body = self.body_of(after)
                    if 0 <= body < end:
                        self.symbol(label, first, self.close(body), [*scope, name], False)
                        self.spans.append((body + 1, self.close(body), [*scope, name, label]))
                        self.statements(body + 1, self.close(body), [*scope, name, label], False)
                        i = self.close(body) + 1
                        continue
                    i = self.close(after) + 1
                    continue
                if not member.text.startswith("@"):
                    i = self.until(after, end)
                    continue
            i = after
        return end + 1

    # calls

    def called(self, known: set[str]) -> None:
        """Every call inside a function that is a symbol, in the order of the text."""
        marks: dict[int, list] = {}
        for begin, end, scope in sorted(self.spans, key=lambda s: (s[0], -s[1])):
            marks.setdefault(begin, []).append((end, scope))
        stack: list[tuple[int, list[str] | None, str | None]] = [(len(self.t), [], None)]
        for i, t in enumerate(self.t):
            while stack[-1][0] <= i and len(stack) > 1:
                stack.pop()
            for end, scope in marks.get(i, []):
                if scope is None:
                    stack.append((end, None, None))  # a class: only its methods are read
                elif end > i:
                    own = ".".join([*([self.module] if self.module else []), *scope])
                    stack.append((end, scope, own if own in known else stack[-1][2]))
            _, scope, caller = stack[-1]
            if caller is None or scope is None:
                continue
            if t.kind == "mark" and t.text == "(" or t.kind == "template" and t.text.startswith("`"):
                self.call(i, scope, caller)

    def call(self, i: int, scope: list[str], caller: str) -> None:
        last = i - 1
        if self.is_(last, "?."):
            last -= 1
        if self.is_(last, ">") and (j := self.type_arguments(last)) >= 0:
            last = j - 1
        first = self.callee(last)
        if first < 0 or self.is_(i, "(") and (self.is_(self.close(i) + 1, "{") or self.is_(self.close(i) + 1, "=>")) and first == last:
            return  # a method of an object or parameters, or nothing that can be called
        if first == last and self.is_(first, "async") and self.is_(i, "("):
            return  # parameters of an arrow function
        if self.is_(first - 1, "new") and not any(self.t[k].text == "(" and self.t[k].partner < last for k in range(first, last)):
            return
        if self.is_(first - 1, "function", "class") or self.is_(first - 2, "function") and self.is_(first - 1, "*"):
            return
        row = {"caller": caller, "scope": ".".join([*([self.module] if self.module else []), *scope]), "module": self.module, "line": self.t[first].line, "name": None, "target": None, "expression": None}
        text = self.source.text[self.t[first].start : self.t[last].end]
        if first == last and self.t[first].kind == "name" and text not in ("super", "import", "this"):
            self.calls.append(row | {"form": "name", "name": text, "target": self.names.get(text)})
        else:
            self.calls.append(row | {"form": "attribute", "expression": text.replace("\n", " ")[:200]})

    def type_arguments(self, i: int) -> int:
        """Where the type arguments that end at i begin, or -1 if that is no list of types."""
        depth = 0
        for j in range(i, max(-1, i - 60), -1):
            t = self.t[j]
            depth += t.text == ">"
            depth -= t.text == "<"
            if not depth:
                return j if self.t[j - 1].kind == "name" and j and self.t[j - 1].end == t.start else -1
            if t.kind == "mark" and t.text not in ("<", ">", ",", ".", "[", "]", "|", "&", "{", "}", ":", "=>", "(", ")"):
                return -1
        return -1

    def callee(self, i: int) -> int:
        """The first token of the chain of members that ends at i, or -1 if nothing there can be called."""
        while i >= 0:
            t = self.t[i]
            if t.kind == "mark" and t.text in (")", "]") or t.kind == "template" and t.partner >= 0 and not t.text.endswith("${"):
                i = t.partner
                before = self.t[i - 1] if i else None
                chained = before is not None and (before.kind == "name" and before.text not in _UNCALLED or before.kind == "mark" and before.text in (")", "]"))
                if chained and self.t[i].kind == "mark":
                    i -= 1
                    continue
                if self.t[i].text == "[" and not chained or before is not None and before.kind == "name" and before.text in _UNCALLED - _BEFORE:
                    return -1 if self.t[i].text != "[" else i
            elif t.kind == "name":
                if t.text in _UNCALLED and not self.is_(i - 1, ".", "?."):
                    return -1
            elif t.kind not in ("string", "template", "number"):
                return -1
            if self.is_(i - 1, ".", "?."):
                i -= 2
                continue
            return i
        return -1


def read_file(path: str, content: bytes) -> dict:
    """All facts of one file; a file that can't be decoded or scanned has its error and nothing else."""
    none = {"symbols": [], "imports": [], "calls": []}
    try:
        r = Reader(path, scan(content.decode("utf-8", "replace")))
    except (ValueError, RecursionError) as e:
        return none | {"parse_ok": False, "error": f"{type(e).__name__}: {e}"}
    return {"parse_ok": True, "error": None, "symbols": r.symbols, "imports": r.imports, "calls": r.calls}


def facts(files: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each row (ord, path, sha256, content)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_file(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"ord": pdf["ord"], "path": pdf["path"], "sha256": pdf["sha256"], **{k: [r[k] for r in rows] for k in ("parse_ok", "error", "symbols", "imports", "calls")}})

    return files.select("ord", "path", "sha256", "content").mapInPandas(run, SCHEMA)


def import_rows(found: DataFrame) -> DataFrame:
    """(id, from_file, kind, from_module, module, line)."""
    rows = found.select("path", F.posexplode("imports").alias("at", "i"))
    return rows.select(F.concat(F.lit("imp:"), "path", F.lit(":"), F.col("at").cast("string")).alias("id"), F.concat(F.lit("file:"), "path").alias("from_file"), "i.*")

"""Symbols of source files: exact for Python, JSON, TOML, HTML, Markdown and reStructuredText; by declaration lines
for other languages, where a symbol ends with its braces, its indentation or its `end`.

Every symbol has kind, name, signature, doc_comment, line_start, line_end, visibility, is_async.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.parsing.chunks import _markdown, _rst, _text, kind_of

#: File name endings and the languages that they stand for.
LANGUAGES = {
    "bash": "bash", "sh": "bash", "zsh": "bash", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "css": "css",
    "ex": "elixir", "exs": "elixir", "go": "go", "hs": "haskell", "html": "html", "htm": "html", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "json": "json",
    "lua": "lua", "md": "markdown", "markdown": "markdown", "php": "php", "py": "python", "pyi": "python", "rb": "ruby", "rs": "rust", "rst": "rst", "svelte": "svelte", "toml": "toml",
    "ts": "typescript", "tsx": "tsx", "txt": "text", "yaml": "yaml", "yml": "yaml",
}

#: Declarations of a language: kind and a pattern whose group `name` is the symbol's name.
_C_LIKE = [("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{?"), ("enum", r"^\s*(?:typedef\s+)?enum(?:\s+class)?\s+(?P<name>\w+)"), ("macro", r"^\s*#\s*define\s+(?P<name>\w+)")]
_JS = [
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<name>[\w$]+)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
    ("const", r"^(?:export\s+)?const\s+(?P<name>[\w$]+)"),
]
_TS = [("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>[\w$]+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)")]
_JVM = r"^\s*(?:(?:public|protected|private|internal|static|final|abstract|sealed|partial|virtual|override|async|readonly|synchronized|default)\s+)*"
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)"),
        ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("type_alias", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
        ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("const", r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<name>[A-Z]\w*)"),
        ("static", r"^\s*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<name>\w+)"), ("macro", r"^\s*macro_rules!\s+(?P<name>\w+)"),
    ],
    "go": [("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("struct", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("type_alias", r"^type\s+(?P<name>\w+)"), ("const", r"^const\s+(?P<name>\w+)")],
    "javascript": _JS, "typescript": _TS + _JS, "tsx": _TS + _JS, "svelte": _TS + _JS,
    "java": [("interface", _JVM + r"@?interface\s+(?P<name>\w+)"), ("enum", _JVM + r"enum\s+(?P<name>\w+)"), ("class", _JVM + r"(?:class|record)\s+(?P<name>\w+)"), ("method", _JVM + r"(?:<[^>]+>\s+)?[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\s*\{")],
    "csharp": [("interface", _JVM + r"interface\s+(?P<name>\w+)"), ("enum", _JVM + r"enum\s+(?P<name>\w+)"), ("struct", _JVM + r"struct\s+(?P<name>\w+)"), ("class", _JVM + r"(?:class|record)\s+(?P<name>\w+)"), ("method", _JVM + r"[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;]*\)\s*(?:\{|=>|$)")],
    "c": [*_C_LIKE, ("function", r"^[A-Za-z_][\w\s*]*?\b(?P<name>[A-Za-z_]\w*)\s*\([^;]*\)\s*\{?\s*$")],
    "cpp": [("class", r"^\s*(?:template\s*<.*>\s*)?class\s+(?P<name>\w+)"), ("module", r"^\s*namespace\s+(?P<name>[\w:]+)"), *_C_LIKE, ("function", r"^\s*[A-Za-z_][\w\s*&:<>,]*?\b(?P<name>[A-Za-z_][\w:~]*)\s*\([^;]*\)\s*(?:const)?\s*(?:noexcept)?\s*\{?\s*$")],
    "php": [("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(?P<name>\w+)"), ("interface", r"^\s*interface\s+(?P<name>\w+)"), ("trait", r"^\s*trait\s+(?P<name>\w+)"), ("function", r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)")],
    "ruby": [("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("class", r"^\s*class\s+(?P<name>[\w:]+)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)"), ("function", r"^\s*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\b")],
    "elixir": [("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("macro", r"^\s*defmacrop?\s+(?P<name>[\w?!]+)"), ("function", r"^\s*defp?\s+(?P<name>[\w?!]+)")],
    "haskell": [("module", r"^module\s+(?P<name>[\w.]+)"), ("enum", r"^(?:data|newtype)\s+(?P<name>\w+)"), ("type_alias", r"^type\s+(?P<name>\w+)"), ("trait", r"^class\s+(?:.*=>\s*)?(?P<name>\w+)"), ("function", r"^(?P<name>[a-z_][\w']*)\s*::")],
    "bash": [("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+(?P<name>[\w-]+)"), ("const", r"^\s*(?:readonly|declare\s+-r)\s+(?P<name>\w+)"), ("static", r"^\s*(?:export\s+)?(?P<name>[A-Z_][A-Z0-9_]*)=")],
    "css": [("class", r"^\s*(?P<name>[.#&:\w\[@][^{};]*?)\s*\{"), ("const", r"^\s*(?P<name>--[\w-]+)\s*:")],
    "yaml": [("property", r"^(?P<name>[\w.-]+)\s*:")],
}

END_WORD = {"ruby", "lua", "elixir"}
Symbol = dict


def _symbol(kind: str, name: str, line: int, end: int, signature: str = "", doc: str | None = None, visibility: str = "public", is_async: bool = False) -> Symbol:
    return {"kind": kind, "name": name, "signature": signature, "doc_comment": doc, "line_start": line, "line_end": end, "visibility": visibility, "is_async": is_async}


def _python(source: str) -> Iterator[Symbol]:
    tree = ast.parse(source)
    lines = source.split("\n")

    def visit(body, owner: str | None) -> Iterator[Symbol]:
        for item in body:
            if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(item, ast.ClassDef)
                marks = {d.id for d in getattr(item, "decorator_list", []) if isinstance(d, ast.Name)}
                kind = "class" if is_class else "property" if "property" in marks else "method" if owner else "function"
                first = item.body[0].lineno
                head = " ".join(x.strip() for x in lines[item.lineno - 1 : max(item.lineno, first - 1)])
                yield _symbol(kind, item.name, item.lineno, item.end_lineno, head.rstrip(":"), ast.get_docstring(item), "private" if item.name.startswith("_") and not item.name.startswith("__") else "public", isinstance(item, ast.AsyncFunctionDef))
                if is_class:
                    yield from visit(item.body, item.name)
            elif isinstance(item, (ast.Assign, ast.AnnAssign)) and owner is None:
                for target in item.targets if isinstance(item, ast.Assign) else [item.target]:
                    if isinstance(target, ast.Name) and target.id.upper() == target.id:
                        yield _symbol("const", target.id, item.lineno, item.end_lineno, lines[item.lineno - 1].strip())

    yield from visit(tree.body, None)


def _keys(value: object, at: Callable[[str], int]) -> Iterator[Symbol]:
    for key, inner in value.items() if isinstance(value, dict) else ():
        line = at(key)
        yield _symbol("module" if isinstance(inner, dict) else "property", str(key), line, line, f"{key}: {type(inner).__name__}")


def _line_of(source: str, pattern: str) -> Callable[[str], int]:
    def find(key: str) -> int:
        m = re.search(pattern.format(re.escape(key)), source, re.MULTILINE)
        return source.count("\n", 0, m.start()) + 1 if m else 1

    return find


def _json(source: str) -> Iterator[Symbol]:
    return _keys(json.loads(source), _line_of(source, r'"{}"\s*:'))


def _toml(source: str) -> Iterator[Symbol]:
    return _keys(tomllib.loads(source), _line_of(source, r"^\s*(?:\[+\s*)?{}\b"))


def _headings(finder) -> Callable[[str], Iterator[Symbol]]:
    def read(source: str) -> Iterator[Symbol]:
        lines = source.split("\n")
        marks = [m for m in finder(lines) if m[1]]
        for i, (line, level, title) in enumerate(marks):
            stop = next((m[0] for m in marks[i + 1 :] if m[1] <= level), len(lines))
            yield _symbol("module", title, line + 1, stop, "#" * level + " " + title)

    return read


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[Symbol] = []

    def handle_starttag(self, tag, attrs):
        marks = dict(attrs)
        line = self.getpos()[0]
        if "-" in tag:
            self.found.append(_symbol("component", tag, line, line, self.get_starttag_text()))
        elif marks.get("id"):
            self.found.append(_symbol("struct", marks["id"], line, line, self.get_starttag_text()))


def _html(source: str) -> Iterator[Symbol]:
    reader = _Tags()
    reader.feed(source)
    return iter(reader.found)


def _end(lines: list[str], at: int, language: str) -> int:
    """The last line of the symbol that begins on line `at` (from 0)."""
    if language in END_WORD:
        indent = len(lines[at]) - len(lines[at].lstrip())
        for i in range(at + 1, len(lines)):
            if lines[i].strip().startswith("end") and len(lines[i]) - len(lines[i].lstrip()) <= indent:
                return i
        return at
    depth, opened = 0, False
    for i in range(at, len(lines)):
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", "", lines[i])
        depth += code.count("{") - code.count("}")
        opened = opened or "{" in code
        if opened and depth <= 0:
            return i
        if not opened and (code.rstrip().endswith((";", ",")) or (i > at and not code.strip())):
            return i if code.strip() else i - 1
    return at if not opened else len(lines) - 1


def _doc_above(lines: list[str], at: int) -> str | None:
    """Comment lines right above, attributes between them skipped."""
    out = []
    for i in range(at - 1, -1, -1):
        bare = lines[i].strip()
        if bare.startswith(("#[", "@")):
            continue
        m = re.match(r"^(?:///?!?|//!|/\*\*?|\*/?|#|--+|;+)\s?(.*?)(?:\*/)?$", bare)
        if not m or not bare:
            break
        out.append(m[1].strip())
    text = "\n".join(reversed(out)).strip()
    return text or None


def _declared(language: str) -> Callable[[str], Iterator[Symbol]]:
    rules = [(kind, re.compile(pattern)) for kind, pattern in DECLARATIONS[language]]
    skip = re.compile(r"^\s*(?:return|if|else|for|while|switch|catch|new|throw|case)\b")

    def read(source: str) -> Iterator[Symbol]:
        lines = source.split("\n")
        for at, line in enumerate(lines):
            if skip.match(line):
                continue
            for kind, rule in rules:
                if m := rule.match(line):
                    name, bare = m["name"].strip(), line.strip()
                    hidden = bool(re.match(r"(?:private|protected|defp\b|local\b|static\b)", bare)) or (language == "rust" and not bare.startswith("pub")) or (language == "go" and not name[0].isupper())
                    end = at if kind in ("const", "static", "macro", "property", "type_alias") and "{" not in line else _end(lines, at, language)
                    yield _symbol(kind, name, at + 1, end + 1, bare.rstrip("{").strip(), _doc_above(lines, at), "private" if hidden else "public", bool(re.search(r"\basync\b", line)))
                    break

    return read


READERS: dict[str, Callable[[str], Iterator[Symbol]]] = {language: _declared(language) for language in DECLARATIONS} | {
    "python": _python, "json": _json, "toml": _toml, "html": _html, "markdown": _headings(_markdown), "rst": _headings(_rst), "text": _headings(_text),
}


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else None


def extract_api(source: str, path: str) -> list[Symbol]:
    """The symbols of a file; none for unknown languages and files that don't parse."""
    reader = READERS.get(language_of(path) or "")
    try:
        return list(reader(source)) if reader else []
    except (SyntaxError, ValueError, RecursionError):
        return []


SCHEMA = "path string, kind string, name string, signature string, doc_comment string, line_start int, line_end int, visibility string, is_async boolean"


def extract_symbols(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Symbols of every file, where the files are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p} | s for p, body in zip(frame.path, frame.content, strict=True) for s in extract_api(body or "", p or "")]
            if rows:
                yield pd.DataFrame(rows)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def language_column(path: Column) -> Column:
    """The language of a path by its ending, as a map lookup."""
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.get(F.array(F.create_map(*pairs)), F.lit(0)).getItem(F.lower(F.substring_index(path, ".", -1)))


def is_document(path: Column) -> Column:
    """Documentation files by ending, name or folder."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.rlike(r"\.(md|markdown|mdx|rst|txt|adoc)$") | name.rlike(r"^(readme|changelog|license|contributing)(\.|$)") | F.lower(path).rlike(r"(^|/)docs?/")


#: Names of folders that hold tests (case counts), and endings and names of test files (in lower case).
TEST_FOLDERS = [
    "test", "tests", "spec", "specs", "__tests__", "__mocks__", "__snapshots__", "testdata", "test_data", "fixtures", "e2e", "integration_tests", "unit_tests", "benches", "benchmarks", "examples",
]
TEST_ENDINGS = [
    "_test.go", "_test.rs", ".test.js", ".test.ts", ".test.tsx", ".test.jsx", ".test.mjs", ".test.cjs", ".spec.js", ".spec.ts", ".spec.tsx", ".spec.jsx", ".spec.mjs", ".spec.cjs", "_test.py", "_test.exs",
]
TEST_NAMES = ["conftest.py", "setup_test.go"]


def is_test(path: Column) -> Column:
    """Test files by folder or name."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ending = F.exists(F.array(*map(F.lit, TEST_ENDINGS)), lambda e: name.endswith(e))
    return F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | ending | name.isin(*TEST_NAMES) | name.rlike(r"^test_.*\.py$")


__all__ = ["extract_api", "extract_symbols", "is_document", "is_test", "kind_of", "language_column", "language_of"]

"""File sources: project walks, manifests, whole files, registries of packages."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.text import glob_regex
from lakewright.parsing.symbols import is_test, language_column

FILE_COLUMNS = "path string, content string"


def rules_of(text: str) -> list[tuple[str, bool, bool, bool]]:
    """(pattern, negated, folders only, anchored) of an ignore file."""
    rules = []
    for line in text.split("\n"):
        line = line.rstrip()
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            body = line[negated:]
            rules.append((body.strip("/"), negated, body.endswith("/"), "/" in body.rstrip("/")))
    return rules


def _ignore_rules(folder: str, names: tuple[str, ...]) -> list[tuple[str, bool, bool, bool]]:
    rules = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as lines:
                rules += rules_of(lines.read())
        except OSError:
            continue
    return rules


def ignored(relative: str, is_folder: bool, rules: list[tuple[str, list[tuple[str, bool, bool, bool]]]]) -> bool:
    """Whether the last rule that meets a path, of its folder's and those above, ignores it."""
    out = False
    for base, own in rules:
        inner = relative[len(base) :].lstrip("/") if base else relative
        for pattern, negated, folders, anchored in own:
            if folders and not is_folder:
                continue
            hit = re.match(glob_regex("/" + pattern if anchored else pattern).replace("^/", "^"), inner) if anchored else fnmatch.fnmatch(inner.rsplit("/", 1)[-1], pattern)
            if hit:
                out = not negated
    return out


def walk(root: str, *, mode: str = "project", ignore_files: tuple[str, ...] = (".gitignore",), pruned: tuple[str, ...] = (".git",), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> list[str]:
    """Relative paths under a local root, sorted. `project` honours ignore files and prunes folders; `raw` lists every file."""
    out: list[str] = []
    rules: list[tuple[str, list[tuple[str, bool, bool, bool]]]] = []
    for folder, folders, files in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        base = "" if base == "." else base
        at = lambda name, base=base: f"{base}/{name}" if base else name
        if mode == "project":
            rules = [r for r in rules if not r[0] or base == r[0] or base.startswith(r[0] + "/")]
            if own := _ignore_rules(folder, ignore_files):
                rules.append((base, own))
            folders[:] = [d for d in folders if d not in pruned and not ignored(at(d), True, rules)]
            files = [f for f in files if not ignored(at(f), False, rules)]
        out += [at(f) for f in files]
    keep = [p for p in out if not include or any(re.match(glob_regex(g), p) for g in include)]
    return sorted(p for p in keep if not any(re.match(glob_regex(g), p) for g in exclude))


def read_files(spark: SparkSession, root: str, *, glob: str | None = None, skip_binary: bool = True, skip_tests: bool = False) -> DataFrame:
    """(path, content, language, size_bytes, line_count) of files under a path that Spark reads; files with a NUL byte are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    start = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//)?", ""), "^/*" + re.escape(re.sub("^[a-z]+:(//)?", "", start).lstrip("/")) + "/?", "")
    rows = raw.where(F.position(F.lit(b"\x00"), F.col("content")) == 0) if skip_binary else raw
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    shaped = rows.select(path.alias("path"), text.alias("content"), F.col("length").alias("size_bytes")).where("content IS NOT NULL")
    named = shaped.withColumns({"language": language_column(F.col("path")), "line_count": F.length("content") - F.length(F.replace("content", F.lit("\n"))) + F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 0).otherwise(1)})
    return named.where(~is_test(F.col("path"))) if skip_tests else named


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """One Parquet scan of the paths that can be read; the others are left out. None if there is none."""
    found = []
    for path in paths:
        try:
            spark.read.parquet(path).schema  # noqa: B018
            found.append(path)
        except Exception as problem:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
    return spark.read.option("ignoreMissingFiles", "true").parquet(*found) if found else None


def manifest_dependencies(name: str, content: str) -> list[tuple[str, str, str]]:
    """(ecosystem, package, version) of a Cargo.toml, package.json, pyproject.toml or requirements file; first by name wins."""
    found: dict[str, tuple[str, str, str]] = {}
    base = name.rsplit("/", 1)[-1]

    def add(ecosystem: str, package: str, version: object) -> None:
        found.setdefault(package, (ecosystem, package, version if isinstance(version, str) else (version or {}).get("version", "*") if isinstance(version, dict) else "*"))

    try:
        if base == "Cargo.toml":
            data = tomllib.loads(content)
            for part in ("dependencies", "dev-dependencies", "build-dependencies"):
                for package, version in (data.get(part) or data.get("workspace", {}).get(part) or {}).items():
                    add("rust", package, version)
        elif base == "package.json":
            data = json.loads(content)
            for part in ("dependencies", "devDependencies", "peerDependencies"):
                for package, version in (data.get(part) or {}).items():
                    add("npm", package, version)
        elif base == "pyproject.toml":
            for line in tomllib.loads(content).get("project", {}).get("dependencies", []):
                add("pypi", *_requirement(line))
        elif re.match(r"requirements.*\.txt$", base):
            for line in content.splitlines():
                if (bare := line.split("#")[0].strip()) and not bare.startswith("-"):
                    add("pypi", *_requirement(bare))
    except (ValueError, AttributeError):
        return []
    return list(found.values())


def _requirement(line: str) -> tuple[str, str]:
    m = re.match(r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?=?\s*([^,;\s]+))?", line)
    return (m[1], m[2] or "*") if m else (line, "*")


def dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, package, version) of the manifests among files (path, content)."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *d) for p, body in zip(frame.path, frame.content, strict=True) for d in manifest_dependencies(p, body or "")]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "package", "version"])

    manifests = files.where(F.col("path").rlike(r"(^|/)(Cargo\.toml|package\.json|pyproject\.toml|requirements[^/]*\.txt)$"))
    return manifests.select("path", "content").mapInPandas(run, "path string, ecosystem string, package string, version string")


def merge_registries(parts: list[DataFrame], limit: int = 20) -> DataFrame:
    """Package rows (name, version, ecosystem, description, downloads, ...) of several registries, most downloaded first."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.orderBy(F.desc_nulls_last("downloads"), "ecosystem", "name").limit(limit)

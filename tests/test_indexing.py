"""The indexing job against fresh runs, and listings against the driver's walk."""

import os

import pytest
from pyspark.sql import functions as F

from lakewright.operators import indexing, search
from lakewright.sources import files, listing


def lines(rows):
    split = rows.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).where("text <> ''")
    return split.select("path", F.concat_ws("#", "path", "at").alias("id"), "text")


def titles(rows):
    return rows.select("path", F.split("content", "\n")[0].alias("title"))


def job(spark, folder):
    return indexing.Indexer(spark, folder, {"chunks": lines, "titles": titles}, ("chunks", "chunk", "id", ["text"]))


def contents(done, version=None):
    index = done.index(version)
    return (
        sorted(map(tuple, done.read("files", version).collect())), sorted(map(tuple, done.read("chunks", version).collect())), sorted(map(tuple, done.read("titles", version).collect())),
        sorted(map(tuple, search.search(index, "fox OR be*", limit=999).collect())),
    )


def test_runs(spark, tmp_path, monkeypatch):
    schema = "path string, content string"
    first = {"a": "a fox\nand a bear", "b": "bees\n\nbe here", "c": "nothing", "d": None, "e": "the same"}
    second = {"a": "a fox\nand two bears", "c": "nothing", "d": "fox now", "e": "the same", "f": "fox bees"}
    frames = [spark.createDataFrame(list(x.items()), schema) for x in (first, second)]
    kept = job(spark, str(tmp_path / "kept"))
    assert kept.run(frames[0]) == indexing.Run(1, 5, 0)
    assert kept.run(frames[0]) == indexing.Run(1, 0, 0)
    before = contents(kept)
    commit = kept.versions.commit
    monkeypatch.setattr(kept.versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):  # all is written, but the pointer isn't moved
        kept.run(frames[1])
    monkeypatch.setattr(kept.versions, "commit", commit)
    assert contents(kept) == before
    assert kept.run(frames[1]) == indexing.Run(2, 3, 1)
    fresh = job(spark, str(tmp_path / "fresh"))
    fresh.run(frames[1])
    assert contents(kept) == contents(fresh) and contents(kept, 1) == before


def test_listings(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\n/build/\n!keep.log\n# note\n", "a.py": "", "x.log": "", "keep.log": "", "build/out.txt": "", "src/build/in.txt": "", "src/.gitignore": "*.tmp\n!deep/special.tmp\nskip/\n",
        "src/b.tmp": "", "src/skip/c.py": "", "src/deep/special.tmp": "", "src/deep/d.log": "", "src/deep/.gitignore": "!d.log\n", ".git/config": "", "docs/é ü.md": "x", "empty/.gitignore": "*\n", "empty/e.txt": "", "src/tests/t.py": "12345",
    }
    for name, body in tree.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(body)
    for more in ({}, {"mode": "raw"}, {"include": ("*.py", "**/*.py"), "exclude": ("src/tests/**",)}, {"ignore_files": (), "pruned": ("src",)}):
        got = listing.list_files(spark, str(tmp_path), **more)
        assert sorted(r.path for r in got.collect()) == files.walk(str(tmp_path), **more), more
    assert {r.path: r.size for r in listing.list_files(spark, str(tmp_path)).collect()}["src/tests/t.py"] == 5

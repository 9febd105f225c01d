"""Documents cut into titled chunks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk at most, and characters that a chunk repeats of the one before it.
MOST_CHARS, OVERLAP = 2048, 200

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ADORNMENT = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}\s*$")
#: A line end that two blank lines follow.
BLANKS = re.compile(r"\n(?=[ \t]*\n[ \t]*\n)")
NUMBERED = re.compile(r"^\d+(?:\.\d+)*[.)]?\s+\S.{0,78}$")


def kind_of(path: str) -> str:
    name = path.lower()
    return "markdown" if name.endswith((".md", ".markdown", ".mdx")) else "rst" if name.endswith((".rst", ".rest")) else "text"


def _markdown(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(line, level, title) of headings; a thematic break is a heading of level 0 without a title."""
    fence = None
    for at, line in enumerate(lines):
        if m := FENCE.match(line):
            fence = m[1][0] if fence is None else None if m[1][0] == fence else fence
        elif fence is None:
            if m := ATX.match(line):
                yield at, len(m[1]), (m[2] or "").strip()
            elif at and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line) and lines[at - 1].strip() and not ATX.match(lines[at - 1]) and not RULE.match(lines[at - 1]):
                yield at - 1, 1 if line.strip()[0] == "=" else 2, lines[at - 1].strip()
            elif RULE.match(line):
                yield at, 0, ""


def _rst(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """Levels follow the order in which adornments first appear, over-and-under ones apart."""
    levels: dict[tuple[str, bool], int] = {}
    at = 0
    while at < len(lines) - 1:
        over = ADORNMENT.match(lines[at])
        if over and at + 2 < len(lines) and lines[at + 1].strip() and (under := ADORNMENT.match(lines[at + 2])) and under[1] == over[1]:
            yield at, levels.setdefault((over[1], True), len(levels) + 1), lines[at + 1].strip()
            at += 3
        elif not over and lines[at].strip() and (under := ADORNMENT.match(lines[at + 1])) and len(lines[at + 1].rstrip()) >= len(lines[at].rstrip()):
            yield at, levels.setdefault((under[1], False), len(levels) + 1), lines[at].strip()
            at += 2
        else:
            at += 1


def _text(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """Capital lines and numbered lines that stand alone."""
    stripped = [line.strip() for line in lines]
    for at, bare in enumerate(stripped):
        # long lines, the most of a text's characters, are told apart first
        if not bare or len(bare) > 80 or (at and stripped[at - 1]) or (at + 1 < len(lines) and stripped[at + 1]):
            continue
        if (bare.upper() == bare and sum(map(str.isalpha, bare)) > 2) or NUMBERED.match(bare):
            yield at, 1 + bare.split()[0].rstrip(".)").count(".") if NUMBERED.match(bare) else 1, bare


def sections(content: str, kind: str) -> list[tuple[str | None, list[str], int, str]]:
    """(title, path of titles, character offset, text) of each section, the text before the first heading included."""
    lines = content.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    marks = list({"markdown": _markdown, "rst": _rst, "text": _text}[kind](lines))
    if kind == "text" and not marks:
        cuts = [-1, *(m.start() for m in BLANKS.finditer(content)), len(content)]
        bodies = [(a + 1, content[a + 1 : b]) for a, b in zip(cuts, cuts[1:])]
        return [(None, [], at, body) for at, body in bodies if body.strip()]
    out, stack = [], []
    spans = [(0, None, "")] * bool(not marks or marks[0][0] > 0) + marks
    for i, (line, level, title) in enumerate(spans):
        stop = starts[spans[i + 1][0]] if i + 1 < len(spans) else len(content)
        if level:
            stack = [x for x in stack if x[0] < level] + [(level, title)]
        body = content[starts[line] : stop]
        if body.strip():
            out.append((stack[-1][1] if stack and level != 0 else None if level is None else (stack[-1][1] if stack else None), [t for _, t in stack], starts[line], body))
    return out


def split_long(text: str, most: int = MOST_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, part): cut at the last blank line, else the last line end, of the last `overlap` characters, else hard."""
    out, at = [], 0
    while len(text) - at > most:
        stop = at + most
        tail = text[stop - overlap : stop]
        for mark in ("\n\n", "\n"):
            if (found := tail.rfind(mark)) >= 0:
                stop = stop - overlap + found + len(mark)
                break
        out.append((at, text[at:stop]))
        at = max(stop - overlap, at + 1)
    out.append((at, text[at:]))
    return out


def chunk_document(content: str, path: str) -> list[dict]:
    """Chunks in order: index, title, section_path, content, byte_offset, char_len."""
    out, at, byte = [], 0, 0
    for title, trail, offset, body in sections(content, kind_of(path)):
        for shift, part in split_long(body):
            if part.strip():
                at, byte = offset + shift, byte + len(content[at : offset + shift].encode())
                out.append({"chunk_index": len(out), "title": title, "section_path": trail, "content": part, "byte_offset": byte, "char_len": len(part)})
    return out


SCHEMA = {"path": "string", "chunk_index": "int", "title": "string", "section_path": "array<string>", "content": "string", "byte_offset": "long", "char_len": "int"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
#: Characters of chunks that a worker passes on together, and documents that it takes at a time.
PART_CHARS, PART_DOCS = 4 << 20, 64


def chunk_documents(docs: DataFrame, *, path: str, content: str, columns: list[str] | None = None) -> DataFrame:
    """Chunks of every document, where the documents are; `columns` names those that are wanted."""
    wanted = list(SCHEMA) if columns is None else columns
    schema = pa.schema([(c, _ARROW[SCHEMA[c]]) for c in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PART_DOCS) for whole in batches for at in range(0, whole.num_rows, PART_DOCS)):
            rows, size = [], 0
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for chunk in chunk_document(body.as_py() or "", p or ""):
                    rows.append({"path": p} | {c: chunk[c] for c in wanted if c != "path"})
                    size += chunk["char_len"]
                    if size >= PART_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    source = docs.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))
    return source.mapInArrow(run, ", ".join(f"{c} {SCHEMA[c]}" for c in wanted))

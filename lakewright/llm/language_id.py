"""Language identification by hyperdimensional letter n-gram profiles.

Every letter class has a fixed random +1/-1 vector. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a text's vector bundles (adds) those of its n-grams, and a
language's prototype bundles the texts that carry its name. A text gets the language of the prototype
with the highest cosine.

Training counts (language, n-gram) over all learnable texts in Spark; the driver gets at most
CLASSES ** 3 sums a language, whatever the input. Scoring happens where rows are, without a shuffle.

Defined results: a null text, one without letters, or no prototype at all gives `und` and score 0; ties
go to the alphabetically first language; whole texts are read; repeated rows give repeated rows; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of the vectors, letter classes (0: no letter; 1 to 26: a to z; the rest by code point), the seed.
DIMENSIONS, CLASSES, SEED = 1024, 64, 20_240_229
UNKNOWN = "und"
#: Characters and texts that are bundled together at most; a longer text goes alone.
CHUNK_CHARS, CHUNK_TEXTS = 400_000, 128

_LETTERS: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """The class of every code point; built once a process."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint8)
        rest = CLASSES - 27
        for point in range(0x110000):
            if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
                table[point] = point - 96 if 97 <= point <= 122 else 27 + point % rest
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_vectors() -> list[np.ndarray]:
    """The class vectors as they enter an n-gram's first, second and third place."""
    base = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIMENSIONS)).astype(np.float32) * 2 - 1
    return [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams of the whole text, white space around it included, that hold a letter; empty if there is none."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    classes = letter_classes()[points].astype(np.int32)
    codes = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
    return codes[codes > 0]


def bundle(codes: np.ndarray, weights: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """weights (texts x codes) times the codes' vectors, some thousand codes at a time."""
    total = np.zeros((weights.shape[0], DIMENSIONS), np.float32)
    for at in range(0, len(codes), 8192):
        part = codes[at : at + 8192]
        bound = vectors[0][part // CLASSES**2] * vectors[1][part // CLASSES % CLASSES] * vectors[2][part % CLASSES]
        total += weights[:, at : at + 8192] @ bound
    return total


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows; summed within a batch first, so a hot language sends few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            pending: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                pending.setdefault(name, []).append(grams(value))
            for name, codes in pending.items():
                if name not in sums:
                    if len(sums) >= 64:  # keeps memory bounded with very many names
                        yield from _flush(sums)
                    sums[name] = np.zeros(CLASSES**3, np.int64)
                sums[name] += np.bincount(np.concatenate(codes), minlength=CLASSES**3)
        yield from _flush(sums)

    found = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    return found.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _flush(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in sums.items():
        used = np.flatnonzero(counts)
        arrays = [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])
    sums.clear()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names in order and their prototypes of length one."""
    rows = count_grams(docs, text, lang).collect()
    names = sorted({row.lang for row in rows})
    if not names:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    codes = np.array(sorted({row.gram for row in rows}), np.int64)
    weights = np.zeros((len(names), len(codes)), np.float32)
    column = {code: at for at, code in enumerate(codes.tolist())}
    place = {name: at for at, name in enumerate(names)}
    for row in rows:
        weights[place[row.lang], column[row.gram]] = row.n
    total = bundle(codes, weights / np.maximum(weights.sum(1, keepdims=True), 1), letter_vectors())
    return names, (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, *, text: str = "text", keep: list[Column]) -> DataFrame:
    """The columns of `keep`, then lang_pred and score (the cosine, cut to 0..1)."""
    kept = docs.select(*keep, F.col(text).alias("_text_"))
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, profile = shared.value
        vectors = letter_vectors()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            labels, scores = [], []
            for part in _chunks(texts):
                a, b = _score(part, known, profile, vectors)
                labels += a
                scores += b
            arrays = [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for value in texts:
        part.append(value)
        size += len(value or "")
        if size >= CHUNK_CHARS or len(part) >= CHUNK_TEXTS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _score(texts, names, prototypes, vectors) -> tuple[list[str], list[float]]:
    codes = [grams(x or "") for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in codes])
    flat = np.concatenate(codes)
    if not len(flat) or not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    seen = np.zeros(CLASSES**3, bool)
    seen[flat] = True
    used = np.flatnonzero(seen)
    column = np.zeros(CLASSES**3, np.int64)
    column[used] = np.arange(len(used))
    counts = np.bincount(owner * len(used) + column[flat], minlength=len(texts) * len(used)).reshape(len(texts), -1)
    total = bundle(used, counts.astype(np.float32), vectors)
    cosines = (total @ prototypes.T) / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    best = cosines.argmax(1)
    values = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
    return (
        [names[i] if len(c) else UNKNOWN for i, c in zip(best.tolist(), codes, strict=True)],
        [round(v, 6) if len(c) else 0.0 for v, c in zip(values.tolist(), codes, strict=True)],
    )


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """Learns from rows whose crc32(key) is no multiple of `folds` and predicts for all: key, held_out, lang_pred, score."""
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
    names, prototypes = fit(docs.where(~held_out), text=text, lang=lang)
    return predict(docs, names, prototypes, text=text, keep=[F.col(key), held_out.alias("held_out")])

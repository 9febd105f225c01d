"""Quality by ordinal regression over hashed tokens and their style.

Graded ratings come from two 0/1 columns: 0 is poor quality, 1 is good but toxic, 2 is good. The grade
feeds expected_grade; selection keeps a document if P(grade >= 1) reaches the threshold.

Defined results: a null or empty text has no tokens, gets the base rate and is judged by it; without rated
documents, or with one grade only, every document is kept and has no grade (null); whole texts are read;
repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm import ordinal

GRADES = 3


def grade() -> Column:
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)


def fit(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text") -> ordinal.Model:
    rows = ordinal.rated_sample(docs, ratings, grade(), key=key, text=text, reading="share")
    present = sorted({row[0] for row in rows})
    return ordinal.fit([(present.index(g), ids, values) for g, ids, values in rows], "share", len(present))


def score_documents(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: list[Column] | None = None) -> DataFrame:
    """Per row: key (or the columns of `keep`), keep, expected_grade, p_good, p_best."""
    model = fit(docs, ratings, key=key, text=text)
    scored = ordinal.score(docs, model, text=text, keep=keep or [F.col(key)])
    first, second = F.get("tails", F.lit(0)), F.get("tails", F.lit(1))
    names = [c for c in scored.columns if c not in ("expected", "tails")]
    return scored.select(
        *(F.col(f"`{c}`") for c in names),
        F.coalesce(first >= threshold, F.lit(True)).alias("keep"),
        F.when(first.isNotNull(), F.round("expected", 6)).alias("expected_grade"),
        F.round(first, 6).alias("p_good"),
        F.round(second, 6).alias("p_best"),
    )

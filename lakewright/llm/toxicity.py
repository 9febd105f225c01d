"""Toxicity severity by ordinal regression over the presence of hashed words.

Ratings are 0/1; the severity grades are derived from them: 0 is not toxic; toxic documents get 1, or 2 if
at least as many of the features that mark toxicity occur in them as in the median toxic document.

Defined results: a null or empty text has no features and gets the base rate; without rated documents, or
with one rating only, nothing is toxic and the expected severity is 0; whole texts are read; repeated rows
give repeated rows; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm import ordinal

GRADES = 3


def graded(rows: list[ordinal.Row]) -> list[ordinal.Row]:
    """0/1 ratings to severity grades 0, 1, 2."""
    if len({row[0] for row in rows}) < 2:
        return rows
    in_toxic, in_clean = np.zeros(ordinal.BUCKETS), np.zeros(ordinal.BUCKETS)
    for g, ids, _ in rows:
        (in_toxic if g else in_clean)[ids] += 1
    toxic = sum(1 for row in rows if row[0])
    marks = np.zeros(ordinal.BUCKETS, bool)
    marks[ordinal.select_features(rows)] = True
    marks &= in_toxic / toxic > 4 * in_clean / (len(rows) - toxic)
    hits = [int(marks[ids].sum()) for _, ids, _ in rows]
    middle = max(1, median(h for h, row in zip(hits, rows, strict=True) if row[0]))
    return [(0 if not g else 2 if h >= middle else 1, ids, values) for h, (g, ids, values) in zip(hits, rows, strict=True)]


def score_documents(docs: DataFrame, ratings: DataFrame, *, rating: str = "toxic", key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: key, toxic (P(severity >= 1) reaches the threshold), expected_severity, p_toxic, p_severe."""
    rows = ordinal.rated_sample(docs, ratings, F.col(rating), key=key, text=text, reading="presence")
    rows = graded(rows)
    model = ordinal.fit(rows, "presence", max((row[0] for row in rows), default=0) + 1)
    scored = ordinal.score(docs, model, text=text, keep=[F.col(key)])
    first, second = (F.coalesce(F.get("tails", F.lit(k)), F.lit(0.0)) for k in (0, 1))
    return scored.select(
        key,
        (first >= threshold).alias("toxic"),
        F.round("expected", 6).alias("expected_severity"),
        F.round(first, 6).alias("p_toxic"),
        F.round(second, 6).alias("p_severe"),
    )

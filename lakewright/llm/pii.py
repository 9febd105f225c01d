"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Generators propose spans, which may overlap: the four base patterns; looser and tighter ones for what these miss (addresses
   with "(at)", IPv6, phone numbers without a plus, numbers that a base match has run together with their neighbours);
   and long mixed tokens, which may be secrets.
2. Every candidate has a check of its own normal form (range of octets, checksum, number of digits; for a secret that it is
   assigned to a name like "token"). Base matches that pass are kept as they are, and so are assigned secrets.
3. Labels: a base match or a secret by its check; another candidate is positive if it overlaps a kept base span of its kind,
   negative if it fails its check or overlaps one of another kind. What passes its check and overlaps nothing kept has no
   label: it is open. Boosted trees learn the label from format and context alone, never from the check; kind, not
   generator, is a feature, so what holds for labelled candidates carries over to the open ones of the same form.
   All labelled candidates of all documents count; they are added up to cells of equal binned features in Spark, and
   the trees are grown from these sums (at most one a combination of bins).
4. On the held-out fold a threshold for each kind is calibrated to PRECISION. A kind's precision is smoothed by PRIOR
   candidates of the precision of all kinds, so that few candidates count little and none are needed. Open candidates
   (and secrets that nothing is assigned to) that reach it are added.

Trees become CASE expressions, so scoring runs in the JVM like the rest.

Defined results: a null text counts as empty; positions are code points, ends exclusive; whole texts are searched and spans
may have any length; rows that repeat a doc_id and text get the same result each; an empty table gives an empty result;
further input columns are ignored. Patterns are written with possessive runs, so that no text makes them backtrack.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import materialise

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
#: Kind, whether it is a base pattern, what a text must match to be searched at all, and the pattern. A run can only
#: begin a leftmost match at its first character, or where the last match ended (\G); so the others are never tried.
GENERATORS = [
    ("email", True, "@", _RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9][ -]?[0-9]", r"(?:\G|(?<![0-9]))[0-9](?=[ -]?[0-9])[0-9]*+(?:[ -][0-9]++)*+"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, r"(?i)[(\[{]at[)\]}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[a-z0-9-]++(?: ?(?:\.|[(\[{]dot[)\]}]) ?[a-z0-9-]++)++"),
    ("ip", False, r"[0-9A-Fa-f]:[0-9A-Fa-f:]", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
    ("phone", False, r"[0-9)][ .-][0-9]", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    ("phone", False, r"\+[0-9]", r"\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{10,15})(?![0-9])"),
    ("card", False, r"[0-9]{4}[ -]?[0-9]{4}", r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"),
    (SECRET, True, r"[A-Za-z0-9+/_-]{20}", r"(?:\G|(?<![A-Za-z0-9+/_-]))(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"),
]
OBFUSCATED, COLONS = 4, 5
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = r"(?i)(?:e-?mail|mail|phone|tel|call|fax|mobile|card|visa|credit|account|ip|addr|host|server|contact)[^A-Za-z]*$"
ASSIGNED = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credentials?|auth)[a-z0-9_-]*[\"']?\s*(?::|=>?|:=)\s*[\"']?$"
#: Binned features of a candidate; none of them is what decides a label.
FEATURES = ["sort", "seps", "size", "before", "after", "cue", "lead", "uniform"]
CONTEXT, ROUNDS, DEPTH, RATE, SMOOTH, PRECISION, PRIOR = 24, 24, 3, 0.3, 1.0, 0.9, 4


def _luhn(digits: Column) -> Column:
    """Whether the checksum of 14 to 19 digits holds."""
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, F.substring(back, i, 1).cast("int")).otherwise(2 * F.substring(back, i, 1).cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _sort_of(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"^\s$"), 1).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike("^[0-9]$"), 3).otherwise(4)


def _number(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in names)), i + 1)


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, kind, base, begin, end, valid, features): one row for each distinct proposal; h is the text's hash.

    Whole matches are checked, of whatever length (20 digits are enough to see that there are too many); the features
    are taken from their first 64 characters."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cut = source.select(
        "key",
        "h",
        *(F.when(F.col("text").rlike(need), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m{i}") for i, (_, _, need, pattern) in enumerate(GENERATORS)),
        *(F.when(F.col("text").rlike(need), F.split("text", pattern, -1)).alias(f"g{i}") for i, (_, _, need, pattern) in enumerate(GENERATORS)),
    ).where(" OR ".join(f"size(m{i}) > 0" for i in range(len(GENERATORS))))

    def proposals(i: int) -> Column:
        gaps, kind = F.col(f"g{i}"), GENERATORS[i][0]
        return F.coalesce(
            F.transform(
                f"m{i}",
                lambda m, at: F.struct(
                    F.lit(i).alias("gen"),
                    at.alias("at"),
                    F.length(F.get(gaps, at)).alias("gap"),
                    F.length(m).alias("length"),
                    F.substring(_normal(m, i), 1, 64).alias("shown"),
                    (F.substring(F.regexp_replace(m, "[^0-9]", ""), 1, 20) if kind in ("card", "phone") else F.lit("")).alias("whole"),
                    (m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$") if (kind, i) == ("ip", 1) else _six(m) if i == COLONS else F.lit(False)).alias("octets"),
                    F.right(F.get(gaps, at), F.lit(CONTEXT)).alias("left"),
                    F.substring(F.get(gaps, at + 1), 1, 1).alias("right"),
                ),
            ),
            F.array(),
        )

    rows = cut.select("key", "h", F.explode(F.concat(*(proposals(i) for i in range(len(GENERATORS))))).alias("x")).select("key", "h", "x.*").distinct()
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("key", "h", "gen").orderBy("at")))
    placed = placed.withColumns({"kind": _number([k for k, *_ in GENERATORS], F.col("gen")), "base": F.element_at(F.array(*(F.lit(b) for _, b, *_ in GENERATORS)), F.col("gen") + 1)})
    digits = F.regexp_replace("shown", "[^0-9]", "")
    seps = F.length(F.regexp_replace("shown", "[0-9A-Za-z]", ""))
    valid = (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("octets"))
        .when(F.col("kind") == "card", _luhn(F.col("whole")))
        .when(F.col("kind") == "phone", F.length("whole").between(10, 15))
        .otherwise(F.col("left").rlike(ASSIGNED))
    )
    return placed.select(
        "key",
        "h",
        "kind",
        "base",
        (F.col("end") - F.col("length")).alias("begin"),
        "end",
        valid.alias("valid"),
        (F.array_position(F.array(*(F.lit(k) for k in [*KINDS, SECRET])), F.col("kind")).cast("int")).alias("sort"),
        F.least(seps, F.lit(6)).alias("seps"),
        F.least(F.floor(F.length("shown") / 4), F.lit(12)).cast("int").alias("size"),
        _sort_of(F.right("left", F.lit(1))).alias("before"),
        _sort_of(F.col("right")).alias("after"),
        F.col("left").rlike(CUES).cast("int").alias("cue"),
        F.when(digits == "", 10).otherwise(F.substring(digits, 1, 1).cast("int")).alias("lead"),
        F.when(digits.rlike(r"^([0-9])\1*$"), 1).otherwise(0).alias("uniform"),
    )


def _normal(match: Column, i: int) -> Column:
    """The form that features are taken from: an address with its signs put back."""
    if i != OBFUSCATED:
        return match
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(match, r"(?i) ?[(\[{]at[)\]}] ?", "@"), r"(?i) ?[(\[{]dot[)\]}] ?", "."), r" ?\. ?", ".")


def _six(match: Column) -> Column:
    """Eight groups, or fewer with one gap."""
    groups = F.size(F.split(match, ":", -1))
    gaps = F.size(F.split(match, "::", -1)) - 1
    return (((groups == 8) & (gaps == 0)) | ((gaps == 1) & (groups <= 8))) & ~match.contains(":::") & match.rlike(":[0-9A-Fa-f]{1,4}$|::$")


def labelled(found: DataFrame) -> DataFrame:
    """Adds `label` (null: open) and `fixed` (kept without a score).

    Which kept base spans a candidate overlaps is read off running sums over its document's candidates: of each kind the
    latest end so far, and the next begin. So no candidates are paired, however many a document has."""
    kept = F.col("base") & F.col("valid") & (F.col("kind") != SECRET)
    so_far = Window.partitionBy("key", "h").orderBy("begin").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("key", "h").orderBy(F.desc("begin")).rangeBetween(Window.unboundedPreceding, -1)
    marks = found
    for name, window in (("e", so_far), ("b", later)):
        of = {k: F.when(kept & (F.col("kind") == k), F.col("end" if name == "e" else "begin")) for k in KINDS}
        marks = marks.withColumns({f"_{name}_{k}": (F.max if name == "e" else F.min)(x).over(window) for k, x in of.items()})

    def met(k: str) -> Column:
        return F.coalesce(F.col(f"_e_{k}") > F.col("begin"), F.lit(False)) | F.coalesce(F.col(f"_b_{k}") < F.col("end"), F.lit(False))

    own, other = F.lit(False), F.lit(False)
    for k in KINDS:
        own = F.when(F.col("kind") == k, met(k)).otherwise(own)
        other = other | ((F.col("kind") != k) & met(k))
    label = F.when(F.col("base"), F.col("valid")).when(own, True).when(other | ~F.col("valid"), False)
    known = marks.withColumns({"label": label, "fixed": F.col("base") & F.col("valid")})
    addable = F.col("label").isNull() | ((F.col("kind") == SECRET) & ~F.col("fixed") & ~other)
    return known.withColumn("open", addable).drop(*(f"_{n}_{k}" for n in "eb" for k in KINDS))


def _split(cells: list[tuple], grad: list[float], curve: list[float], members: list[int]) -> tuple | None:
    """(gain, feature, bin): the split of these cells that explains the gradient best."""
    total_g, total_h = sum(grad[i] for i in members), sum(curve[i] for i in members)
    best = None
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = {}
        for i in members:
            s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += curve[i]
        left_g = left_h = 0.0
        for value in sorted(sums)[:-1]:
            left_g, left_h = left_g + sums[value][0], left_h + sums[value][1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - total_g**2 / (total_h + SMOOTH)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, value
    return best


def _leaf(grad: list[float], curve: list[float], members: list[int]) -> float:
    return RATE * sum(grad[i] for i in members) / (sum(curve[i] for i in members) + SMOOTH)


def boost(cells: list[tuple]) -> tuple[float, list]:
    """Start value and trees of DEPTH from (features, positives, negatives); a tree is (feature, bin, left, right) or a value."""
    positives, negatives = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = log((positives + SMOOTH) / (negatives + SMOOTH))
    scores, trees = [start] * len(cells), []

    def grow(members: list[int], grad: list[float], curve: list[float], depth: int):
        best = _split(cells, grad, curve, members) if depth else None
        if best is None:
            return _leaf(grad, curve, members)
        _, f, value = best
        left, right = [i for i in members if cells[i][0][f] <= value], [i for i in members if cells[i][0][f] > value]
        return f, value, grow(left, grad, curve, depth - 1), grow(right, grad, curve, depth - 1)

    for _ in range(ROUNDS if cells else 0):
        chance = [1 / (1 + exp(-s)) for s in scores]
        grad = [c[1] - (c[1] + c[2]) * p for c, p in zip(cells, chance, strict=True)]
        curve = [(c[1] + c[2]) * p * (1 - p) for c, p in zip(cells, chance, strict=True)]
        tree = grow(list(range(len(cells))), grad, curve, DEPTH)
        trees.append(tree)
        scores = [s + value_of(tree, c[0]) for s, c in zip(scores, cells, strict=True)]
    return start, trees


def value_of(tree, features: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _expression(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(FEATURES[tree[0]]) <= tree[1], _expression(tree[2])).otherwise(_expression(tree[3]))


def fit(found: DataFrame) -> tuple[float, list, dict[str, float]]:
    """Start value, trees and thresholds by kind, from all labelled candidates."""
    fold = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    sums = found.where("label IS NOT NULL").groupBy(fold, "kind", *FEATURES).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    rows = sorted(sums.collect(), key=lambda r: tuple(r))
    merged: dict[tuple, list[int]] = {}
    for row in rows:
        if not row.held_out:
            cell = merged.setdefault(tuple(row[f] for f in FEATURES), [0, 0])
            cell[0] += row.pos
            cell[1] += row.neg
    start, trees = boost([(features, pos, neg) for features, (pos, neg) in merged.items()])
    held = [(round(start + sum(value_of(t, tuple(row[f] for f in FEATURES)) for t in trees), 9), row.kind, row.pos, row.neg) for row in rows if row.held_out]
    return start, trees, calibrate(held)


def calibrate(held: list[tuple[float, str, int, int]]) -> dict[str, float]:
    """The lowest score of each kind from which on PRECISION is reached; held has score, kind, positives and negatives."""
    thresholds: dict[str, float] = {}
    counts = {kind: [0, 0] for kind in [*KINDS, SECRET]}
    pooled = [0, 0]
    by_score: dict[float, list] = {}
    for score, kind, pos, neg in held:
        by_score.setdefault(score, []).append((kind, pos, neg))
    for score in sorted(by_score, reverse=True):
        for kind, pos, neg in by_score[score]:
            for sums in (counts[kind], pooled):
                sums[0] += pos
                sums[1] += neg
        prior = PRIOR * pooled[0] / max(1, sum(pooled))
        for kind, (pos, neg) in counts.items():
            if pos + prior >= PRECISION * (pos + neg + PRIOR):
                thresholds[kind] = score - 1e-6
    return thresholds


def find_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, spans, base_spans, secrets): arrays of (begin, order, kind, end) by begin, then kind; documents with spans only.
    Secrets aren't among spans."""
    found = materialise(labelled(materialise(candidates(docs, key, text), "pii-candidates")), "pii-labelled")
    start, trees, thresholds = fit(found)
    score = sum((_expression(tree) for tree in trees), F.lit(float(start)))
    reach = F.lit(None).cast("double")
    for kind, threshold in thresholds.items():
        reach = F.when(F.col("kind") == kind, F.lit(threshold)).otherwise(reach)
    order = F.array_position(F.array(*(F.lit(k) for k in [*KINDS, SECRET])), F.col("kind"))
    span = F.struct(F.col("begin"), order.alias("order"), F.col("kind"), F.col("end"))
    taken = found.where(F.col("fixed") | (F.col("open") & (score >= reach))).select("key", "h", span.alias("span"), F.col("fixed"), (F.col("kind") == SECRET).alias("secret"))
    longest = Window.partitionBy("key", "h", "secret", "span.kind").orderBy("span.begin", F.desc("span.end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = taken.withColumn("reached", F.max("span.end").over(longest)).where("fixed OR reached IS NULL OR span.end > reached")  # not within another of its kind
    return outer.groupBy("key", "h").agg(
        F.sort_array(F.collect_set(F.when(~F.col("secret"), F.col("span")))).alias("spans"),
        F.sort_array(F.collect_set(F.when(F.col("fixed") & ~F.col("secret"), F.col("span")))).alias("base_spans"),
        F.sort_array(F.collect_set(F.when(F.col("secret"), F.col("span")))).alias("secrets"),
    )


def attach(docs: DataFrame, spans: DataFrame, *, key: str, text: str, keep: list[str]) -> DataFrame:
    """Every row of docs, the columns of `keep`, and its spans, base_spans and secrets (null if there are none)."""
    hashed = docs.select(*(F.col(c) for c in keep), F.col(key).alias("_key_"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h_"))
    named = spans.select(F.col("key").alias("_k_"), F.col("h").alias("_hash_"), "spans", "base_spans", "secrets")
    return hashed.join(named, F.col("_key_").eqNullSafe(F.col("_k_")) & (F.col("_h_") == F.col("_hash_")), "left").select(*keep, "_key_", "spans", "base_spans", "secrets")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.coalesce(spans, F.array()), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_secret, secrets, n_found (spans and secrets)."""
    rows = attach(docs, find_spans(docs, key=key, text=text), key=key, text=text, keep=[])
    kinds = F.transform(F.coalesce("base_spans", F.array()), lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    n = {c: F.size(F.coalesce(c, F.array())) for c in ("spans", "base_spans", "secrets")}
    more = {"n_added": n["spans"] - n["base_spans"], "n_secret": n["secrets"], "n_found": n["spans"] + n["secrets"]}
    return rows.select(
        F.col("_key_").alias(key),
        *counts,
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        *(x.cast("long").alias(c) for c, x in more.items()),
        listed(F.col("secrets")).alias("secrets"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in the place of each span; a span that begins inside the last one only lengthens the cut."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(
        spans,
        first,
        lambda a, s: F.when(
            s["begin"] >= a["at"],
            F.struct(
                F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["begin"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")
            ),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
    )
    rest = F.substring(text, (folded["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(F.coalesce(spans, F.array())) > 0, F.concat(folded["out"], rest)).otherwise(text)

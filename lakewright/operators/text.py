"""Lines, grep, full-text search and blending of result lists."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 saturation and length weight (Robertson and Zaragoza).
K1, B = 1.2, 0.75


# --- lines and grep -----------------------------------------------------------------------------------------------


def lines(files: DataFrame, *, path: str, content: str) -> DataFrame:
    """(path, line_no from 1, line): a final line feed opens no line, and carriage returns before line feeds go."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"\n$", "")
    rows = files.where(F.length(content) > 0).select(F.col(path).alias("path"), F.posexplode(F.split(body, "\n")).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


@dataclass(frozen=True)
class GrepOptions:
    """How a pattern is read and what is reported. case: smart (insensitive if the pattern has no capital), sensitive, insensitive."""

    case: str = "smart"
    fixed: bool = False
    word: bool = False
    before: int = 2
    after: int = 2
    max_count: int | None = None
    invert: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    limit: int | None = None


def pattern_of(pattern: str, options: GrepOptions) -> str:
    """The Java regular expression of a pattern under the options."""
    body = re.escape(pattern) if options.fixed else pattern
    body = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])" if options.word else body
    literal = re.sub(r"\\.", "", pattern) if not options.fixed else pattern
    folded = options.case == "insensitive" or (options.case == "smart" and literal == literal.lower())
    return f"(?iu){body}" if folded else body


def glob_regex(glob: str) -> str:
    """A path glob: ** spans folders, * and ? don't, [..] is a class, and {a,b} are choices."""
    out, at, depth = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        if c == "[" and (stop := glob.find("]", at + 2)) > 0:
            inner = glob[at + 1 : stop]
            out, at = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", stop + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        at += 1
    return f"^(?:.*/)?{out}$" if "/" not in glob else f"^{out}$"


def path_filter(path: Column, options: GrepOptions) -> Column:
    wanted = reduce(lambda a, b: a | b, (path.rlike(glob_regex(g)) for g in options.include)) if options.include else F.lit(True)
    return reduce(lambda a, b: a & ~b, (path.rlike(glob_regex(g)) for g in options.exclude), wanted)


def grep(files: DataFrame, pattern: str, options: GrepOptions = GrepOptions(), *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no, line, before, after) of matching lines.

    Files that can't match are dropped by one test of the whole text before any line is made; context is a row frame
    over the lines of the files that are left.
    """
    regex = pattern_of(pattern, options)
    named = files.where(path_filter(F.col(path).cast("string"), options))
    if not options.invert:
        named = named.where(F.col(content).rlike(f"(?m){regex}"))
    every = lines(named, path=path, content=content)
    order = Window.partitionBy("path").orderBy("line_no")
    if options.before:
        every = every.withColumn("before", F.collect_list("line").over(order.rowsBetween(-options.before, -1)))
    if options.after:
        every = every.withColumn("after", F.collect_list("line").over(order.rowsBetween(1, options.after)))
    match = F.col("line").rlike(regex)
    found = every.where(~match if options.invert else match)
    if options.max_count is not None:
        found = found.withColumn("_nth_", F.row_number().over(order)).where(F.col("_nth_") <= options.max_count).drop("_nth_")
    return found.orderBy("path", "line_no").limit(options.limit) if options.limit else found


def grep_multiline(files: DataFrame, pattern: str, options: GrepOptions = GrepOptions(), *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no, line_end, match): matches that may span lines, by the lines on which they begin and end. A dot
    doesn't match a line end unless the pattern says (?s)."""
    regex = f"(?m){pattern_of(pattern, options)}"
    named = files.where(path_filter(F.col(path).cast("string"), options) & F.col(content).rlike(regex))
    found = named.select(F.col(path).alias("path"), F.regexp_extract_all(content, F.lit(regex), F.lit(0)).alias("found"), F.split(content, regex, -1).alias("gaps"))
    ends = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    each = F.transform("found", lambda m, at: F.struct(at.alias("at"), m.alias("match"), ends(m).alias("inner"), ends(F.get("gaps", at)).alias("gap")))
    rows = found.select("path", F.explode(each).alias("x")).select("path", "x.*")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("gap") + F.col("inner")).over(before)
    numbered = rows.select("path", (upto - F.col("inner") + 1).alias("line_no"), (upto + 1).alias("line_end"), "match", "at")
    if options.max_count is not None:
        numbered = numbered.where(F.col("at") < options.max_count)
    return numbered.drop("at")


def grep_target(paths: list[str] | None = None, packages: list[str] | None = None, everything: bool = False) -> tuple[str, list[str]]:
    """What a grep reads: exactly one of paths, packages and all cached packages must be asked for."""
    given = [("paths", paths or []), ("packages", packages or []), ("all", ["*"] if everything else [])]
    asked = [(kind, names) for kind, names in given if names]
    if len(asked) != 1:
        raise ValueError("exactly one of paths, packages and all must be given")
    return asked[0]


def grep_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("path").agg(F.count("*").alias("n"))


def grep_stats(matches: DataFrame, files: DataFrame) -> DataFrame:
    """files_searched, files_matched and matches in one row."""
    found = matches.agg(F.count("*").alias("matches"), F.count_distinct("path").alias("files_matched"))
    return files.agg(F.count("*").alias("files_searched")).crossJoin(F.broadcast(found))


def enclosing_symbol(matches: DataFrame, symbols: DataFrame, keys: list[str], *, bin_size: int = 64, id_column: str = "symbol_id") -> DataFrame:
    """Adds the first symbol by line_start, then id, whose line range holds line_no; null where there is none.

    A range join as an equi-join: symbols are put in the bins of lines that they cover, and a match in its own bin.
    """
    covered = symbols.withColumn("_bin_", F.explode(F.sequence(F.floor(F.col("line_start") / bin_size), F.floor(F.col("line_end") / bin_size))))
    placed = matches.withColumn("_bin_", F.floor(F.col("line_no") / bin_size))
    joined = placed.join(covered, [*keys, "_bin_"]).where(F.col("line_no").between(F.col("line_start"), F.col("line_end")))
    first = joined.groupBy(*keys, "line_no").agg(F.min(F.struct("line_start", id_column)).alias("_first_"))
    return matches.join(first, [*keys, "line_no"], "left").withColumns({id_column: F.col(f"_first_.{id_column}"), "line_start": F.col("_first_.line_start")}).drop("_first_")


# --- full-text search ------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@cache
def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one plain letter with marks, and those letters."""
    marked, plain = [], []
    for code in range(0x80, 0x1F00):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if letter.isalpha() and len(base) == 1 and base != letter:
            marked.append(letter)
            plain.append(base)
    return "".join(marked), "".join(plain)


def folded(text: Column) -> Column:
    """In lower case and without diacritics, composed or not. ASCII, told by its bytes, has none, and translating is slow."""
    lower = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lower).otherwise(F.regexp_replace(F.translate(lower, *_accents()), r"\p{Mn}+", ""))


def fold(text: str) -> str:
    """What folded does, to a query."""
    plain = text.lower().translate(str.maketrans(*_accents()))
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


def postings(docs: DataFrame, key: str, text: str, *, stem=None) -> DataFrame:
    """(term, key, tf, length): an inverted index; `stem` maps a frame of distinct terms to (term, stem)."""
    spread = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("all")).select("key", F.size("all").alias("length"), F.explode("all").alias("term"))
    counted = spread.groupBy("term", "key", "length").agg(F.count("*").alias("tf"))
    if stem is None:
        return counted
    stems = stem(counted.select("term").distinct())
    return counted.join(stems, "term").groupBy(F.col("stem").alias("term"), "key", "length").agg(F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, query: list[str], *, key: str, text: str, require_all: bool = True, limit: int = 20) -> DataFrame:
    """(key, score): documents with all (or any) query terms by BM25, best first, ties by key.

    Statistics and candidates come from one pass that keeps only what the query asks of each document, so nothing
    but matching documents and one row of totals is shuffled.
    """
    terms = sorted(set(query))
    words = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("all"))
    tf = {f"tf{i}": F.size("all") - F.size(F.array_remove("all", term)) for i, term in enumerate(terms)}
    read = words.select("key", F.size("all").alias("length"), *(c.alias(n) for n, c in tf.items()))
    totals = read.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *(F.count_if(F.col(n) > 0).alias(f"d{n}") for n in tf))
    joiner = (lambda a, b: a & b) if require_all else (lambda a, b: a | b)
    matching = read.where(reduce(joiner, (F.col(n) > 0 for n in tf)))
    joined = matching.crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for n in tf:
        idf = F.ln(1 + (F.col("docs") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
        score = score + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.select(F.col("key").alias(key), F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


@dataclass(frozen=True)
class Match:
    """A parsed full-text query: groups that must all hold, each an OR of phrases or prefixes; and what must not occur."""

    groups: tuple[tuple[str, ...], ...]
    excluded: tuple[str, ...]


def parse_match(query: str) -> Match:
    """Terms are joined by AND; OR, NOT, "phrases" and prefix* are understood. An empty query is an error."""
    parts = re.findall(r'"[^"]*"|\S+', query)
    groups: list[list[str]] = []
    excluded: list[str] = []
    mode = "and"
    for part in parts:
        if part in ("AND", "OR", "NOT"):
            mode = part.lower()
            continue
        term = part.strip('"').lower()
        if not term:
            continue
        if mode == "not":
            excluded.append(term)
        elif mode == "or" and groups:
            groups[-1].append(term)
        else:
            groups.append([term])
        mode = "and"
    if not groups:
        raise ValueError("an empty full-text query")
    return Match(tuple(map(tuple, groups)), tuple(excluded))


def matches(text: Column, query: Match) -> Column:
    """Whether a text satisfies a parsed query, over its tokens joined by single spaces."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))

    def holds(term: str) -> Column:
        words = " ".join(re.findall(r"[^\W_]+", term))
        return joined.contains(f" {words}") if term.endswith("*") else joined.contains(f" {words} ")

    wanted = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(holds, group)) for group in query.groups))
    return reduce(lambda a, b: a & ~b, map(holds, query.excluded), wanted)


def positional_relevance(ranked: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds relevance (n - i) / n of the i-th of n rows of each group, i from 0."""
    part = Window.partitionBy(*group)
    n = F.count("*").over(part)
    return ranked.withColumn("relevance", (n - F.row_number().over(part.orderBy(*order)) + 1) / n)


def snippet(text: Column, terms: list[str], *, width: int = 64, opening: str = "[", closing: str = "]") -> Column:
    """The `width` words that hold the most different terms, then the most hits, then come first, with hits marked; null
    without a hit. Windows are tried from each hit on."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    bare = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")
    wanted = F.array(*map(F.lit, terms))
    hits = F.filter(F.transform(words, lambda w, at: F.struct(at.alias("at"), bare(w).alias("word"))), lambda h: F.array_contains(wanted, h["word"]))

    def worth(h: Column) -> Column:
        inside = F.filter(hits, lambda o: (o["at"] >= h["at"]) & (o["at"] < h["at"] + width))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda o: o["word"]))).alias("terms"), F.size(inside).alias("hits"), (-h["at"]).alias("order"))

    best = -F.array_max(F.transform(hits, worth))["order"]
    window = F.slice(words, best.cast("int") + 1, F.lit(width))
    marked = F.transform(window, lambda w: F.when(F.array_contains(wanted, bare(w)), F.concat(F.lit(opening), w, F.lit(closing))).otherwise(w))
    return F.when(F.size(hits) > 0, F.array_join(marked, " "))


# --- blending ---------------------------------------------------------------------------------------------------------


def blend(vector_hits: DataFrame, text_hits: DataFrame, *, alpha: float = 0.5, limit: int = 20) -> DataFrame:
    """Hybrid results from (id, name, score, seq) and (id, name, relevance, seq).

    Sides meet on the lower-cased name (or id) by a full outer join; within a side the last row of a name gives the
    score and the first gives the id. Vector scores are mapped from [-1, 1] to [0, 1], alpha is cut to [0, 1], a missing
    side counts 0.
    """
    a = min(1.0, max(0.0, alpha))
    key = F.lower(F.coalesce("name", F.col("id").cast("string")))
    left = vector_hits.groupBy(key.alias("key")).agg(F.min_by("id", "seq").alias("vid"), F.max_by("score", "seq").alias("score"))
    right = text_hits.groupBy(key.alias("key")).agg(F.min_by("id", "seq").alias("tid"), F.max_by("relevance", "seq").alias("relevance"))
    joined = left.join(right, "key", "full_outer")
    combined = a * F.coalesce((F.col("score") + 1) / 2, F.lit(0.0)) + (1 - a) * F.coalesce("relevance", F.lit(0.0))
    return joined.select(F.coalesce("vid", "tid").alias("id"), "key", F.round(combined, 6).alias("combined")).orderBy(F.desc("combined"), "id").limit(limit)


def retrieval_metrics(ranked: DataFrame, *, query: str, place: str, relevant: str, k: int = 5) -> DataFrame:
    """Mean precision at k and mean reciprocal rank over queries."""
    each = ranked.groupBy(query).agg(
        F.count_if((F.col(place) <= k) & F.col(relevant)).alias("hits"), F.coalesce(1 / F.min(F.when(F.col(relevant), F.col(place))), F.lit(0.0)).alias("reciprocal")
    )
    return each.agg(F.round(F.avg("hits") / k, 6).alias("precision_at_k"), F.round(F.avg("reciprocal"), 6).alias("mrr"))

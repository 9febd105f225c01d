import corpus_pipeline
import public_tokenizers
import tiktoken

from lakewright.llm import byte_bpe, pii, quality
from test_decontaminate import words
from test_shingles import grouped

FOLDER = "/root/testdata/sf0.001"


def leaking(texts, items):
    """Keys of texts in which ten words of an item (or all, if it has fewer) stand in a row."""
    windows: dict[int, set] = {}
    for body in items:
        own = words(body)
        size = min(10, len(own))
        windows.setdefault(size, set()).update(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
    found = {k: words(t) for k, t in texts.items()}
    return {k for k, own in found.items() for size, known in windows.items() if size and any(tuple(own[i : i + size]) in known for i in range(len(own) - size + 1))}


def test_run_against_brute_force(spark):
    """What survives is what quality says, then what is first in its group and holds no benchmark window by brute force."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = spark.read.parquet(f"{FOLDER}/labels.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r["keep"]}
    kept = set(grouped({k: texts[k] for k in kept}).values())
    kept -= leaking({k: texts[k] for k in kept}, [r.text for r in items.collect()])
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(found) == kept and len(kept) > 100
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    spans = {r.doc_id: [x.split(":") for x in f"{r.spans},{r.secrets}".strip(",").split(",") if x] for r in pii.report(docs.where(docs.doc_id.isin(*kept))).collect()}
    for key, row in found.items():
        text, out, at = texts[key], "", 0
        for kind, begin, end in sorted(((k, int(b), int(e)) for k, b, e in spans[key]), key=lambda s: s[1]):
            if begin >= at:
                out += text[at:begin] + f"[{kind.upper()}]"
            at = max(at, end)
        assert row.n_tokens == len(library.encode_ordinary(out + text[at:]))


def test_one_id_with_two_texts(spark):
    rows = [(1, "one two three four five six seven eight"), (5, "one two three four five six seven eight"), (5, "nothing like it at all in any way"), (5, "nothing like it at all in any way")]
    left = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted(map(tuple, left.collect())) == [rows[0], rows[2]]


def test_stages_on_awkward_tables(spark):
    rows = [(1, None, None, None, None, 1, "x"), (1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 2, "x"), (None, "some words here", "en", "s", 15, 3, "y"), (3, "mail a@b.co " * 9000, "en", "s", 108_000, 4, "y"), (3, "another text of that id", "en", "s", 23, 4, "y")]
    clashing = ["fp", "keep", "_id_", "_spans_", "_h_", "_gone_", "id", "row", "h", "spans", "_new_", "new", "id_of", "a.b", "secrets", "key", "kept_h"]
    rows = [(*r[:5], *[r[5]] * len(clashing)) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in clashing))
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, FOLDER)
            if name != "token_ids":
                assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString()
            if name == "near_duplicates":
                assert left.where("doc_id IS NOT NULL").groupBy("doc_id", "text").count().where("count > 1").count() == 0
        assert (left.count() > 0) == (table is docs)
    redacted = corpus_pipeline.personal_data_stage(spark, docs, FOLDER).where("length(text) > 1000").head()
    assert redacted.text == "mail [EMAIL] " * 9000 and redacted.n_chars == len(redacted.text)


def test_near_duplicates_are_linked_by_fingerprints_too(spark):
    """Groups of both kinds of links: one that only SimHash finds (few words changed in a repetitive text), and one that only shingles find."""
    from lakewright.llm import shingles, simhash

    base = [f"w{i}" for i in range(40)]
    texts = {1: " ".join(base * 3 + [f"x{i}" for i in range(30)])}
    texts[2] = " ".join(base * 3 + [f"x{i}" for i in range(30)] + ["end"])
    for n in range(3, 60):
        texts[n] = " ".join(base * 12 + [f"{n}y{i}" for i in range(12)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fp, sh = ({r.doc_id: r.component_id for r in x.collect()} for x in (simhash.near_duplicates(docs), shingles.near_copies(docs, width=corpus_pipeline.SHINGLE_WORDS)))
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for links in (fp, sh):
        for k, c in links.items():
            a, b = sorted((root(k), root(c)))
            parent[b] = a
    want = {root(k) for k in texts}
    assert any(fp[k] != k and sh[k] == k for k in texts)  # SimHash alone has links
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()} == want

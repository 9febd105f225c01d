import numpy as np

from lakewright.llm import ordinal, quality, toxicity

DOCS, LABELS = "doc_id long, text string, tails string", "doc_id long, quality int, toxic int"


def table(spark):
    rows = []
    for i in range(400):
        kind = i % 4
        rows.append((i, {0: "plain words that say things", 1: "plain words you awful fool", 2: "AAA!! BBB!! CCC!!", 3: "things that words say"}[kind] + f" n{i % 9}", None))
    labels = [(i, int(i % 4 != 2), int(i % 4 == 1)) for i in range(400)] + [(0, 1, 0), (None, 1, 1), (5, None, None), (9999, 1, 1)]
    extra = [(1000, None, None), (1001, "", None), (1002, "AWFUL, fool!", "x"), (1002, "AWFUL, fool!", "x"), (None, "plain words", None), (1003, "plain words that say things " * 20_000, None)]
    return spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, LABELS)


def test_toxicity(spark):
    docs, labels = table(spark)
    found = toxicity.score_documents(docs, labels).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 406
    assert all(by[i].toxic == (i % 4 == 1) for i in range(400)) and by[1002].toxic and not by[1003].toxic and not by[None].toxic
    assert all(abs(r.expected_severity - r.p_toxic - r.p_severe) < 1e-5 and r.p_severe <= r.p_toxic for r in found)
    assert by[1000].p_toxic == by[1001].p_toxic and not by[1000].toxic


def test_quality(spark):
    docs, labels = table(spark)
    found = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert all(found[i].keep == (i % 4 != 2) for i in range(400)) and found[1003].keep
    assert found[0].expected_grade > found[1].expected_grade > found[2].expected_grade


def test_without_ratings_or_documents(spark):
    docs, labels = table(spark)
    for some in (labels.limit(0), labels.where("quality = 1 AND toxic = 0")):
        assert all(r["keep"] and r.expected_grade is None for r in quality.score_documents(docs, some).collect())
        assert not any(r.toxic or r.expected_severity for r in toxicity.score_documents(docs, some).collect())
    assert quality.score_documents(docs.limit(0), labels).count() == 0 and toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_gradient_against_differences():
    dice = np.random.default_rng(1)
    x, y, params = dice.normal(size=(30, 4)), dice.integers(0, 3, 30), np.array([0.3, -0.2, 0.1, 0.5, -0.4, 0.2])

    def loss(p):
        below = 1 / (1 + np.exp((x @ p[:4])[:, None] - ordinal._thresholds(p[4:])[None, :]))
        padded = np.concatenate([np.zeros((30, 1)), below, np.ones((30, 1))], axis=1)
        return -np.log(padded[np.arange(30), y + 1] - padded[np.arange(30), y]).mean() + ordinal.PENALTY / 2 * (p[:4] ** 2).sum()

    slope = [(loss(params + d) - loss(params - d)) / 2e-6 for d in np.eye(6) * 1e-6]
    assert np.allclose(slope, ordinal._gradient(params, x, y, 2), atol=1e-5)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").limit(4000), spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    toxic = toxicity.score_documents(docs, labels.where("doc_id % 4 <> 0")).join(held.select("doc_id", "quality", labels.toxic.alias("truth")), "doc_id").toPandas()
    good = quality.score_documents(docs, labels.where("doc_id % 4 <> 0")).join(held, "doc_id").toPandas()
    assert (toxic.toxic == (toxic.truth == 1)).mean() > 0.97 and toxic.toxic[toxic.truth == 0].mean() < 0.01
    assert (good["keep"] == (good.quality == 1)).mean() > 0.97

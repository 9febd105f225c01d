from lakewright.llm import language_id

SCHEMA = "doc_id long, text string, lang string, score string"


def rows(spark):
    words = {"aa": "alpha banana casa", "zz": "wyxz qwyk zzyx"}
    data = [(i, f"{words[lang]} {words[lang]}", lang, "x") for i, lang in enumerate(["aa", "zz"] * 20)]
    return spark.createDataFrame([*data, (100, None, None, None), (101, "12 34 !", "aa", None), (102, "", None, None), (None, "banana casa", None, None), (0, data[0][1], "aa", "x"), (103, "casa " * 20000, None, None)], SCHEMA)


def test_languages_and_edges(spark):
    found = {}
    for r in language_id.identify(rows(spark)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert len(found[0]) == 2 and found[0][0] == found[0][1]
    assert {found[i][0].lang_pred for i in range(0, 40, 2)} == {"aa"} and {found[i][0].lang_pred for i in range(1, 40, 2)} == {"zz"}
    for blank in (100, 101, 102):
        assert (found[blank][0].lang_pred, found[blank][0].score) == ("und", 0.0)
    assert found[103][0].lang_pred == "aa" and found[None][0].lang_pred == "aa" and found[None][0].held_out is False
    assert all(0 <= r.score <= 1 for group in found.values() for r in group)


def test_empty_table_and_no_languages(spark):
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    nameless = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert language_id.identify(nameless).head().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, every = found.where("lang_pred = lang").count(), found.count()
    assert every > 100 and right / every > 0.97

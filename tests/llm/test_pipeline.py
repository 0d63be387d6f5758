import pytest

import corpus_pipeline as C
from pagefacts.llm.common import materialize
from pagefacts.llm.jaccard_join import jaccard_components, one_of_each_group


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in C.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf), name))
    for df in kept[:-1]:
        assert df.columns == columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert ids[0] > ids[1] > ids[2] and ids[2] >= ids[3] >= ids[4] == ids[5]
    insults = ("idiot", "moron", "scum", "worthless")
    texts = {r.doc_id: r.text.lower() for r in docs.collect()}
    assert not [d for d in ids[1] if sum(w in texts[d] for w in insults) > 2]
    assert len(ids[1]) > 0.9 * len(ids[0]) * (1 - 0.08)
    groups = {r.doc_id: r.component_id for r in jaccard_components(kept[1]).collect()}
    assert ids[2] == {d for d, c in groups.items() if d == c}
    assert kept[4].count() == kept[5].count()


def test_one_of_each_group(spark):
    rows = [(1, "a b c d e f", 0), (2, "A b c d e f", 0), (2, "other words stand here now", 0), (5, "same text is here twice", 1), (5, "same text is here twice", 2), (6, None, 0), (7, "", 0), (None, "a b c d e f", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").selectExpr("*", "doc_id as _id", "text as _d", "1 as _nr", "2 as doc", "3 as digest", "4 as nr", "5 as d1")
    out = one_of_each_group(df)
    assert out.schema == df.schema and all(r._id == r.doc_id and r._d == r.text and (r._nr, r.doc, r.digest, r.nr, r.d1) == (1, 2, 3, 4, 5) for r in out.collect())
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here now"), (5, "same text is here twice"), (6, ""), (7, "")]


ODD = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "same words stand in this text here", "en", "a", 34), (3, "same words stand in this text here", None, "a", 34), (None, "a text that has no id at all", "en", "b", 27), (4, "word " * 60_000, "en", "a", 300_000), (5, "one", "en", "c", 3), (6, "a wretch of a text, wretch, that is not fine", "en", "c", 44)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, _toxicity string, _id int, _d int, _nr int, score int, doc int, part int, words int, taken_text int"


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_each_stage_on_odd_rows_and_no_rows(spark, sf, name):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names the stages use inside."""
    stage = dict(C.STAGES)[name]
    docs = spark.createDataFrame([(*r, *([0.5, "x"] + [7] * 8)) for r in ODD], COLUMNS)
    out = stage(spark, docs, sf)
    rows = out.collect()
    if name == "token_files":
        assert len(rows) == len(ODD) and stage(spark, docs.limit(0), sf).count() == 0
        return
    assert out.schema == docs.schema and all((r.toxicity, r._toxicity, r._id, r._d, r._nr, r.doc, r.part) == (0.5, "x", 7, 7, 7, 7, 7) for r in rows)
    texts = {(r[0], r[1]) for r in ODD}
    if name != "mixing":
        assert {(r.doc_id, r.text) for r in rows} <= texts
    if name == "near_duplicates":
        assert len(rows) == len(ODD) - 1
    if name == "decontamination":
        assert len(rows) == len(ODD)
    assert stage(spark, docs.limit(0), sf).count() == 0

"""Each stage is held against a brute-force version of its decisions on its own input."""

import corpus_pipeline
import pytest
from test_decontaminate import brute as leaks
from test_neardup import brute as groups
from test_packing import held as packed

from terraquarry.llm import common, pii


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The input and each stage's result, all but the last collected."""
    spark.conf.set(pii.KEY_SETTING, "a key for tests")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf)
        assert result.schema.names == docs.schema.names, name
        docs = common.materialize(result, "test")
        out.append(docs.collect())
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, sf)


def test_language_id_keeps_prose_and_changes_nothing(steps):
    (before, after, *_), _ = steps
    assert set(after) <= set(before)
    dropped = set(before) - set(after)
    assert {r for r in before if not any(c.isalpha() for c in r.text or "")} <= dropped
    assert not [r for r in dropped if len(words := (r.text or "").split()) >= 50 and sum(w.strip(".,").isalpha() for w in words) > 0.95 * len(words) and r.lang is not None]


def test_one_document_of_each_group_stays(steps):
    (_, before, after, *_), _ = steps
    want = {i for i, _, _, kept in groups(sorted((r.doc_id, r.text) for r in before), 5, 80) if kept}
    assert {r.doc_id for r in after} == want


def test_contaminated_documents_go(spark, sf, steps):
    (_, _, before, after, _), _ = steps
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in before], items)}
    assert bad and {r.doc_id for r in after} == {r.doc_id for r in before} - bad


def test_personal_data_is_replaced(spark, steps):
    (*_, before, after), _ = steps
    names = pii.Pseudonyms(pii.session_key(spark))
    texts = {r.doc_id: r for r in after}
    assert len(texts) == len(before)
    for r in before:
        new, _ = names.replace(r.text)
        assert (texts[r.doc_id].text, texts[r.doc_id].n_chars) == (new, len(new))


def test_all_that_is_kept_is_packed(steps):
    (*_, before), last = steps
    packed(last, {r.doc_id: r.text for r in before})


def test_edge_cases(spark, tmp_path):
    """Repeated ids and rows, null ids and texts, empty texts and tables, further columns."""
    prose = " ".join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").orderBy("doc_id").first().text.split()[:80])
    rows = [(0, prose, "en", "s", 1), (0, prose, "en", "s", 1), (0, prose[::-1], "en", "s", 1), (None, prose, "en", "s", 1), (None, None, None, None, None), (5, None, "en", "s", 0), (6, "", "en", "s", 0), (7, "42", "en", "s", 2)]
    frame = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "no such passage in any of these documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == frame.columns
        counts.append(docs.count())
    assert counts[0] - counts[1] == 1  # of the equal rows one goes; the row without an id is in no group
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 0").count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terraquarry.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    learned = {r.lang for r in docs.values() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    found = queries.op8_langid(spark, sf).collect()
    assert len(found) == len(docs)
    right = total = 0
    for r in found:
        doc = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if doc.text is None or not any(c.isalpha() for c in doc.text):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in learned
            if r.held_out and doc.lang is not None:
                total += 1
                right += r.lang_pred == doc.lang
    assert total >= 20 and right / total >= 0.9


def test_predictions_ignore_labels_and_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = langid.fit(other.where(~langid.held_out()))
    assert model.languages == again.languages and np.array_equal(model.table, again.table)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    bare = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    assert plain == {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(bare, model).collect()}


def test_mixtures_find_both_languages():
    table = np.full((langid.BUCKETS, 3), -np.log(langid.BUCKETS), np.float32)
    model = langid.Model(["aa", "bb"], table)
    words = {0: ["alpha", "gamma", "delta"], 1: ["vrykk", "zxzxz", "wqwqw"]}
    for own in words:
        for w in words[own]:
            grams, _, _ = langid.word_trigrams(pa.array([w]))
            table[grams, own] = -3.0
    text = " ".join(words[0] * 30 + words[1] * 10)
    label, score, proportions, other = next(langid.judged(pa.array([text]), model))
    assert label == "aa" and set(proportions) == {"aa", "bb"}
    assert abs(score - 0.75) < 0.05 and other < 0.05
    assert set(next(langid.judged(pa.array([" ".join(words[0] * 30)]), model))[2]) == {"aa"}


def test_edge_cases(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 34 ...", None), (None, "the cat", None), (6, "the cat", None), (6, "the cat", None), (7, "le chat " * 60_000, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    assert got == {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "en"), (7, "fr")}
    kept = langid.identified(docs, model)
    assert kept.schema == docs.schema
    assert {1, 2, 7} <= {r.doc_id for r in kept.collect()} and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    none = langid.fit(docs.where("lang IS NULL"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_mixtures_find_as_many_languages_as_there_are():
    size = 7
    draw = np.random.default_rng(4)
    for count in (1, 4, 6, 7):  # the last of seven components is the uniform one
        parts = [np.where(np.arange(size) == i, 0.0, -12.0) for i in range(count) for _ in range(40 - 4 * i)]
        words = np.array(parts)[draw.permutation(len(parts))].astype(np.float32)
        share = langid.mixtures(words, np.array([0, len(words)]))[0]
        assert (share > 0).sum() == count
        assert np.allclose(share[:count], np.array([40 - 4 * i for i in range(count)]) / len(parts), atol=0.01)


def test_the_bound_loses_no_set():
    draw = np.random.default_rng(6)
    size, first = 9, np.concatenate(([0], np.cumsum(draw.integers(0, 60, 120))))
    words = draw.normal(-8, 3, (first[-1], size)).astype(np.float32)
    got = langid.mixtures(words, first)
    for text, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if a == b:
            assert not got[text].any()
            continue
        likely = np.exp(words[a:b] - words[a:b].max(1, keepdims=True)).astype(np.float64)

        def estimate(allowed):
            share = allowed / allowed.sum()
            for _ in range(langid.ROUNDS):
                part = likely * share
                share = (part / np.maximum(part.sum(1, keepdims=True), 1e-300)).mean(0)
            return share, np.log(np.maximum((likely * share).sum(1), 1e-300)).sum()

        order = np.argsort(-estimate(np.ones(size))[0], kind="stable")
        best, chosen = -np.inf, None
        for count in range(1, size + 1):
            share, fit = estimate(np.isin(np.arange(size), order[:count]).astype(np.float64))
            fit -= langid.PENALTY * (count - 1) * np.log(b - a + 1.0)
            if fit > best + 1e-9:
                best, chosen = fit, share
        assert np.allclose(got[text], chosen, atol=1e-9)


def test_every_label_is_learned(spark):
    draw = random.Random(3)
    spell = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = []
    for lang in range(70):
        words = [spell() for _ in range(12)]
        rows += [(100 * lang + i, " ".join(draw.choices(words, k=25)), f"l{lang:02d}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 70
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert found == {i: lang for i, _, lang in rows}

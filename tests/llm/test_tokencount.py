import random

import sentencepiece

from terraquarry.llm import queries, tokencount

PATH = queries.tokenizer("piece_bpe_32k.model")


def held(found, texts, copies=1):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = found.collect()
    assert len(rows) == copies * len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n := len(model.encode(text)), n > 4096), r.doc_id


def test_all_documents_against_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held(queries.op4_tokens(spark, sf), texts)


def test_edge_cases(spark):
    texts = [None, "", " ", "  ", "\n", "\n\n a", " a", "a ", "a  b", "\ta\t b", "▁", "a▁b", "▁ ▁", "<s>", "</s> <unk>", "<0x0A>", "a\0b", "é😀 漢字", " x　y", "\r\n x", "x" * 50_000, "a \n b\n\n  c   ", "Ａ ﬁ", "0 12  345", "é"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens int")
    held(tokencount.count_tokens(docs, PATH), texts, 2)
    held(tokencount.count_tokens(docs, PATH, sample_rows=1, entries=1), texts, 2)  # all by the second tier
    assert tokencount.count_tokens(docs.limit(0), PATH).count() == 0


def test_random_texts(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices(" \n\tab1.é😀▁<s>", k=draw.randint(0, 60))) for _ in range(400)]
    held(tokencount.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH), texts)


def test_words_that_a_polynomial_hash_confuses(spark):
    word = "a"
    for _ in range(10):  # the Thue-Morse string and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    held(tokencount.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH), texts)


def test_a_hash_that_is_always_equal_changes_no_count(spark, monkeypatch):
    """Bytes decide: with one hash for all spans, counts stay right."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(tokencount.common, "span_hashes", lambda data, starts, ends, fold=False: np.full(len(starts), 5, np.uint64))
    texts = ["aa bb aa cc", "bb", "", "dddd eeee dddd"]
    pieces = tokencount.piece_model(PATH)
    table = tokencount.Table([b" aa", b" bb"], pieces.pre_tokens([b" aa", b" bb"]))
    got = tokencount._sum(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), pieces, tokencount._Cache(), table)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got.tolist() == [len(model.encode(t)) for t in texts]

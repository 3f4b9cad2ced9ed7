import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from terraquarry.llm import packing, queries

PATH = queries.tokenizer("word_bpe_49k.json")


def held(found, texts, copies=1):
    """Every id of every document lies in one piece, and a piece fills a sequence of its own."""
    full = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), []
    for r in found.collect():
        pieces[r.doc_id].append(r)
        sequences.append(r.sequence_id)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and 1 << r.bucket == r.length
    assert len(set(sequences)) == len(sequences)
    assert pieces.keys() == set(range(len(texts))) if isinstance(texts, list) else pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        ids = np.array([*full.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        want = defaultdict(int)
        at = 0
        for length in packing.binary_lengths(len(ids), 2048):
            want[at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)] += copies
            at += length
        assert at == len(ids)
        got = defaultdict(int)
        for r in own:
            got[r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        assert got == want, doc


def test_all_documents_against_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held(queries.op10_packing(spark, sf), texts)


def test_edge_cases(spark):
    texts = [None, "", " ", "a", "A'S don'T", "<|endoftext|> x", "<s> </s> <pad> <unk>", "é É ß ẞ", "é İ", "a\0b\x1f", "漢字 😀", "x" * 30_000, "a b " * 3000, "12 345", "   ", "it's_we'll..!!"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] * 2, "doc_id long, text string, length int")
    held(packing.pack(docs, PATH), texts, 2)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    kept = packing.pack(docs, PATH, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in kept)
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, max_length=1000)


def test_random_texts(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choices("abS'tredlvm 19.,-_éÉß\t\n漢😀́<>|", k=draw.randint(0, 80))) for _ in range(500)]
    held(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH), texts)

import random
import time

import pytest

from terraquarry.llm import pii, queries

VALUES = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "phone": ["(212) 555-0123", "+1 212 555 0123", "212-555-0123", "+49 30 1234567"],
    "address": ["192.168.0.1", "8.8.8.8"],
    "social": ["078-05-1120"],
    "date": ["1984-02-29", "2001/12/31", "24.12.1999"],
    "email": ["Ada.Lovelace+x@mail.example.org", "a@b.co"],
}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation_with_an_inverse(size):
    out = [pii.feistel(i, size, b"k", "t") for i in range(size)]
    assert sorted(out) == list(range(size))
    assert [pii.feistel(o, size, b"k", "t", back=True) for o in out] == list(range(size))


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_pseudonyms_keep_the_format_and_can_be_undone(kind, value):
    names = pii.Pseudonyms(b"key")
    text = f"see {value}, please"
    new, found = names.replace(text)
    assert found == [(4, 4 + len(value), kind)]
    own = new.removeprefix("see ").removesuffix(", please")
    assert new == f"see {own}, please" and own != value
    if kind != "address":  # whose numbers have one to three digits
        assert [c.isalnum() for c in own] == [c.isalnum() for c in value]
    assert pii.KINDS[kind].valid(own)
    back = names._of(kind, own, True)
    assert (back.lower() if kind == "email" else back) == (value.lower() if kind == "email" else value)
    assert pii.Pseudonyms(b"other").replace(text)[0] != new
    assert names.of(kind, value) == own  # linked wherever it stands


def test_formats_of_one_value_stay_linked():
    names = pii.Pseudonyms(b"key")
    assert pii.digits_of(names.of("card", "4111 1111 1111 1111")) == names.of("card", "4111111111111111")
    a, b = names.of("date", "1984-02-29"), names.of("date", "29.02.1984")
    assert pii.Date.read(a) == pii.Date.read(b)
    assert pii.digits_of(names.of("phone", "(212) 555-0123")) == pii.digits_of(names.of("phone", "212-555-0123"))


@pytest.mark.parametrize("text", ["", "4111 1111 1111 1112", "1984-02-30", "256.1.1.1", "000-12-3456", "DE88 3704 0044 0532 0130 00", "v1.2.3.4.5", "a@b", "12-34", "no data at all"])
def test_what_no_rule_validates_stays(text):
    assert pii.Pseudonyms(b"key").replace(text) == (text, [])


def test_long_addresses_are_no_addresses_and_long_values_are_permuted():
    names = pii.Pseudonyms(b"key")
    for text in ("x" * 5000 + "@b.co", "a@" + "b" * 300 + ".co", "x" * 65 + "@b.co"):
        assert names.replace(text) == (text, [])
    assert names.replace("x" * 64 + "@b.co")[1] == [(0, 69, "email")]
    assert pii.feistel(pii.feistel(26**5000 - 1, 26**5000, b"k", "t"), 26**5000, b"k", "t", back=True) == 26**5000 - 1


def test_a_number_is_linked_however_its_country_code_is_set_off():
    names = pii.Pseudonyms(b"key")
    for a, b in (("+353 12345678", "+35312345678"), ("+49 30 1234567", "+49301234567"), ("+7 495 1234567", "+74951234567")):
        assert pii.digits_of(names.of("phone", a)) == pii.digits_of(names.of("phone", b))


def test_a_session_without_a_key_gets_a_new_one(spark):
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set(pii.KEY_SETTING, "x")
    assert pii.session_key(spark) == pii.session_key(spark)


def test_values_of_one_kind_stay_different():
    names, draw = pii.Pseudonyms(b"key"), random.Random(1)
    values = {".".join(str(draw.randrange(256)) for _ in range(4)) for _ in range(2000)}
    assert len({names.of("address", v) for v in values}) == len(values)


def test_queries_and_edge_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    spark.conf.set(pii.KEY_SETTING, "a key for tests")
    found = queries.op6_pii(spark, sf).collect()
    assert len(found) == len(texts)
    names = pii.Pseudonyms(pii.session_key(spark))
    assert sum(r.n_found for r in found) > 0
    for r in found:
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        parts, at = [], 0
        for a, b, kind in spans:
            parts += [texts[r.doc_id][at:a], names.of(kind, texts[r.doc_id][a:b])]
            at = b
        assert r.text == (None if texts[r.doc_id] is None else "".join(parts) + texts[r.doc_id][at:])
    rows = [(1, None), (2, ""), (3, "mail a@b.co"), (3, "mail a@b.co"), (None, "8.8.8.8"), (4, "x" * 400_000 + " 8.8.8.8")]
    odd = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, n_found int, spans string")
    got = [(r.doc_id, r.n_found, r.text is None) for r in pii.pseudonymise(odd, key=b"k").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, True), (2, 0, False), (3, 1, False), (3, 1, False), (None, 1, False), (4, 1, False)], key=str)
    changed = pii.pseudonymised_text(odd, key=b"k")
    assert changed.schema == odd.schema
    assert {(r.n_found, r.spans) for r in changed.collect()} == {(7, "c")}
    assert pii.pseudonymise(odd.limit(0), key=b"k").count() == 0


def test_long_texts_take_linear_time():
    """1, 2 and 4 MB full of values: no value is compared with all the others."""
    line = "on 2021-03-04 from 10.1.2.3 to ann.lee@example.org, card 4111 1111 1111 1111, 05.06.1999 by +49 30 1234567;\n"
    seconds, counts = [], []
    for size in (1, 2, 4):
        start = time.process_time()
        counts.append(len(pii.find(line * (size * 1_000_000 // len(line)))))
        seconds.append(time.process_time() - start)
    assert counts[0] > 40_000 and abs(counts[2] - 4 * counts[0]) < 20
    assert seconds[2] < 8 * seconds[0] + 0.5


def test_found_values_against_every_pair():
    """The same spans as by the definition: kinds in order, and what touches a value found before is left."""
    draw = random.Random(8)
    parts = ["2021-03-04", "10.1.2.3", "ann@ex.org", "4111 1111 1111 1111", "05.06.1999", "+49 30 1234567", "DE89370400440532013000", "078-05-1120", " ", ".", "-", "@", "x", "7"]
    for _ in range(400):
        text = "".join(draw.choices(parts, k=draw.randint(1, 14)))
        want = []
        for kind, rule in pii.KINDS.items():
            for m in rule.pattern.finditer(text):
                if rule.valid(m[0]) and not any(a < m.end() and m.start() < b for a, b, _ in want):
                    want.append((*m.span(), kind))
        assert pii.find(text) == sorted(want), text

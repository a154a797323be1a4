"""Personal data: base kinds against plain patterns, cue kinds by example, texts that must stay clean, long texts."""

import time

import pytest
from brute import personal
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.personal import BASE, KINDS, personal_data, spans_of


def found(text):
    return [(KINDS[k], text[s:e]) for s, k, e in spans_of(text)]


@settings(deadline=None, max_examples=1500)
@given(st.lists(st.sampled_from(["@", ".", "+", "-", " ", "(", ")", "a", "Z", "_", "%", "0", "7", "255", "256", "1.2.3.4", "x@y.z", "4111 1111 1111 1111", "+1 (123) 456-7890", "é", "٣", "00012", "\n"]), max_size=14))
def test_base_kinds_are_the_patterns(parts):
    text = "".join(parts)
    assert [(KINDS[k], s, e) for s, k, e in spans_of(text) if KINDS[k] in BASE] == personal(text)


@pytest.mark.parametrize("text,want", [
    ("pay to DE89 3704 0044 0532 0130 00 today", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("pay to DE88 3704 0044 0532 0130 00 today", []),
    ("Account number: 12345678, closed", [("account", "12345678")]),
    ("SSN 123-45-6789.", [("account", "123-45-6789")]),
    ("He lives at 221B Upper Baker Street, London", [("address", "221B Upper Baker Street")]),
    ('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" |', [("secret", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8")]),
    ("ftp://ada:s3cret@files.example.org/x", [("email", "s3cret@files.example.org"), ("login", "ada:s3cret@files.example.org")]),
])
def test_cues(text, want):
    assert sorted(found(text)) == sorted(want)


@pytest.mark.parametrize("text", [
    "On account of 12 of them, the password was the secret of the street.", "A token of thanks: everything she had. The road to 10 downing.", "In 1984 the 2000 Olympic athletes walked the long road.",
    "see https://example.org/a:b and version 1.2.3 or 999.1.1.1", "call 555 1234", "@ alone, + 5, a@b, 1.2.3", "kontor 1234567", "",
])
def test_clean_texts_stay_clean(text):
    assert found(text) == []


@pytest.mark.parametrize("unit", ["@", "a@", "1", "1.", "1 ", "+1", "+1 ", "a@b.", "token=", "street ", "1 A ", "://a:"])
def test_time_grows_with_the_text(unit):
    began = time.time()
    spans_of(unit * (300_000 // len(unit)))
    assert time.time() - began < 20


def test_hard_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, None), (2, ""), (2, "1.2.3.4")], "doc_id long, text string").selectExpr("*", "7 as id", "'x' as found")
    got = sorted((r["id"] or 0, len(r["found"])) for r in personal_data(docs).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (2, 0), (2, 1)]

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import tokenize as tk


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(tk.read_vocabulary(tk.default_vocabulary()))


def ids(reference, text):
    return reference.encode(text, add_special_tokens=False).ids


def test_every_token_is_its_own_encoding(encoder):
    assert all(encoder.encode_word(t) == [r] for r, t in enumerate(encoder.token))


def test_corpus_as_the_public_library(encoder, reference, spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for t in texts:
        assert encoder.encode(t) == ids(reference, t or "")
        assert encoder.decode(encoder.encode(t)) == (t or "")


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aetinsr ' \n\t.,=-_01éλ中<|>​\x1c\x85", max_size=120)))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == ids(reference, text)


def test_odd_texts(encoder, reference):
    rnd = random.Random(2)
    for t in ["", " ", "\n\n \n", "<|endoftext|>", "a" * 3000, " " * 1000, "é" * 500, "漢字" * 400, "\x00\x1c\x1d", "👩‍🔧" * 9,
              "".join(chr(rnd.randrange(32, 0xD7FF)) for _ in range(3000)), "x\n" * 2000, "word \n\nword"]:
        assert encoder.encode(t) == ids(reference, t)
    assert encoder.encode(None) == []


def test_a_very_long_text(encoder):
    text = "ab1 ".join("qwertyuiop"[i % 10] * (i % 7) for i in range(200_000))
    assert encoder.decode(encoder.encode(text)) == text


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(tk, "WORD_CACHE", 5)
    monkeypatch.setattr(tk, "LINE_CACHE_CHARS", 40)
    e = tk.Encoder(tk.read_vocabulary(tk.default_vocabulary()))
    for i in range(50):
        assert e.decode(e.encode(f"line {i}\nother {i * 7} words\n")) == f"line {i}\nother {i * 7} words\n"
    assert len(e._words) <= 5 and sum(map(len, e._lines)) <= 40


def test_frame(spark, reference, monkeypatch):
    rows = [(1, "hello world", 0), (2, None, 0), (3, "", 0), (3, "hello world", 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in tk.encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, ids(reference, t or "")) for i, t, _ in rows), key=str)
    assert {(r.doc_id, r.n_tokens) for r in tk.token_counts(df).collect()} == {(1, 2), (2, 0), (3, 0), (3, 2), (None, 1)}
    assert tk.encode_corpus(df.limit(0)).count() == 0


def test_vocabulary_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "MOST_VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"1234")
    with pytest.raises(ValueError):
        tk.read_vocabulary(str(tmp_path / "v"))

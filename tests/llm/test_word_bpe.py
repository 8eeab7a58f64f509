"""Ids and texts of the merge rounds against the library."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from stagekin.llm import queries, word_bpe

MIXED = st.text(st.sampled_from("ab'sdtrelmv \t\n\xa0\x85 \x1ć̈éßÀª²0٣漢Σσς.,!?-_<|>İA"), max_size=60)
LONG = " ".join(f"word{k}" for k in range(30_000))
TEXTS = [None, "", " \n", LONG, "x" * 20_000, "漢字" * 5_000, "hello <|endoftext|> world", "A<|ENDOFTEXT|>b",
         "é <|startoftext|><|endoftext|>", "<|endoftext|", "漢 <|endoftext|> x", "I'm we'LL", "a", "a"]


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path(queries.WORD_FILE), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(queries.WORD_FILE))


@pytest.fixture(scope="module")
def encoder(raw):
    return word_bpe.Encoder(raw)


@settings(max_examples=200, deadline=None)
@given(st.lists(MIXED, max_size=5))
def test_ids_equal_the_library(encoder, library, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=4), st.randoms(),
       st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=14), min_size=1, max_size=6))
def test_any_order_of_merges(first, rng, words):
    """Also files in which a pair of a merged symbol ranks lower than the merge that makes it."""
    merges = list(dict.fromkeys(first))
    made = ["a", "b", "c", *(a + b for a, b in merges)]
    merges = list(dict.fromkeys(merges + [(rng.choice(made), rng.choice(made)) for _ in range(12)]))
    rng.shuffle(merges)
    tokens = list(dict.fromkeys([*"abc", *(t for a, b in merges for t in (a, b, a + b))]))
    vocab = {t: k for k, t in enumerate(tokens)}
    model = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    rounds = word_bpe.Rounds(vocab, merges, "")
    for word, ids in zip(words, rounds.ids([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(word).ids


def test_table_with_clashing_columns(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns(
        {"ids": F.lit("own"), "word": F.lit(1)})
    found = queries.word_ids(docs)
    assert found.columns == ["doc_id", "text", "ids", "word", "decoded"]
    for row in found.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids and row.word == 1
        assert bytes(row.decoded).decode() == library.decode(ids, skip_special_tokens=False)
    assert queries.word_ids(docs.limit(0)).count() == 0


def test_the_documents(spark, folder, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op12_word_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        plain = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_other_kinds_of_files_are_refused(raw):
    spec = json.loads(raw)
    spec["model"]["ignore_merges"] = True
    with pytest.raises(ValueError):
        word_bpe.Encoder(json.dumps(spec).encode())

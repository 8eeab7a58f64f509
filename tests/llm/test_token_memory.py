"""What a worker of the token files holds at once."""

import numpy as np
import public_tokenizers

from stagekin.llm import queries, token_store
from stagekin.llm.common import new_folder
from stagekin.llm.word_tokens import WordEncoder


def test_texts_are_taken_as_they_are_encoded():
    with open(public_tokenizers.path(queries.WORD_FILE), "rb") as file:
        words, taken = WordEncoder(file.read()), []

    def texts():
        for k in range(40):
            taken.append(k)
            yield "some words " * 10_000

    found = words.encode(texts())
    next(found)
    assert len(taken) < 20
    assert len([1 for _ in found]) == 39 and len(taken) == 40


def test_a_shard_is_made_piece_after_piece(monkeypatch):
    monkeypatch.setattr(token_store, "PIECE_IDS", 1_000)
    parts = [np.full(300, k, "<u4") for k in range(50)]
    pieces = list(token_store.shard_pieces(list(range(50)), parts, "<u2"))
    assert max(map(len, pieces)) < 5_000 < sum(map(len, pieces))
    shard = token_store.Shard(b"".join(pieces))
    assert [(d, s, ids.tolist()) for d, s, ids in shard.documents()] == [(k, 300 * k, [k] * 300) for k in range(50)]


def test_workers_get_short_batches(spark, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, plain = spark.conf.get(name), token_store.written
    monkeypatch.setattr(token_store, "written", lambda df, label: (seen.append(int(spark.conf.get(name))), plain(df, label))[1])
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    at = new_folder(spark, "test")
    manifest = token_store.write(docs, at, queries.vocabulary(queries.WORD_FILE), queries.WORD_END)
    assert seen[0] <= 1_000 and spark.conf.get(name) == before
    assert token_store.read(manifest, at).count() == 2

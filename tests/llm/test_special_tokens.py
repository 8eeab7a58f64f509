"""Texts that hold the string of an added token, against the library as it is loaded."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stagekin.llm import queries, token_store
from stagekin.llm.common import new_folder

TEXTS = ["hello <|endoftext|> world", "plain words", "A<|ENDOFTEXT|>b", "é <|startoftext|><|endoftext|>", "<|endoftext|",
         "漢 <|endoftext|> x", "", None, "plain <|endof text|>"]


def test_token_files_keep_the_tokens_of_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_FILE))
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [3306, 49407, 1002]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    at = new_folder(spark, "test")
    manifest = token_store.write(docs, at, queries.vocabulary(queries.WORD_FILE), queries.WORD_END)
    start = 0
    for row, text in zip(token_store.read(manifest, at).orderBy("doc_id").collect(), TEXTS, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, queries.WORD_END], "<u4")
        assert (row.start, row.n_tokens, zlib.crc32(row.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)

"""Texts of very long white space: ids of the tokenizer itself, and no end of the process."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from parleyspark.llm import packing
from parleyspark.llm.queries import WHOLE, tokenizer


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(tokenizer(WHOLE).path)


def encoded(text):
    t = tokenizer()
    return np.frombuffer(packing.encoder(t.path, t.pattern, t.special, t.special_id, t.whole)(text), "<u4").tolist()


@pytest.mark.parametrize("space", [" ", "\n", "\t \n", " ", "　 "])
@pytest.mark.parametrize("n", [packing.LONG_SPACE - 1, packing.LONG_SPACE, packing.LONG_SPACE + 1, 1_000_000])
def test_ids(own, space, n):
    text = "a b" + space * (n // len(space)) + "x <|endoftext|>" + space * 3
    assert encoded(text) == own.encode(text, add_special_tokens=False).ids


def test_long_space():
    n = packing.LONG_SPACE
    for before in (0, 1, n - 1, n, n + 1, 3 * n + 17):
        for run, want in ((n - 1, False), (n + 1, True), (2 * n, True)):
            assert packing.long_space("x" * before + " " * run + "y" * 5) is want
            assert packing.long_space("x" * before + "\n " * (run // 2) + " " * (run % 2)) is want


@pytest.mark.parametrize("space", [" ", "\n"])
def test_pack(spark, own, space):
    text = space * 5_000_000 + "x"
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id bigint, text string")
    got = packing.pack(docs, tokenizer()).where("doc_id = 1").orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]).tolist()
    assert ids == own.encode(text, add_special_tokens=False).ids + [0]

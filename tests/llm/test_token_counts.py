"""Token counts against the tokenizer on whole texts."""

import os
import random
from collections import Counter

import pytest
from oracle import SF

from doctree import llm
from doctree.llm import token_counts

PATH = token_counts.tokenizer_path()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def awkward():
    rng = random.Random(5)
    pieces = ["word", "Été", "größe", "don't", "'s", "''ll", "12", "３４", "²", "ª", "日本語", "🎉👩‍👩‍👧", " ", "　", "\x1c", "\x85", "\t", "\n", "\r\n", " ", "  ", "   ", "<|endoftext|>", "<|endof", "...", "#$%", "_", "é", "́", "a" * 50]
    found = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return [None, "", " ", "  ", "\n", "a  <|endoftext|>", " <|endoftext|> <|endoftext|>", *found, "long " * 5000, "x" * 20000, " " * 5000 + "y", *found[:5]]


def test_counts_are_those_of_whole_texts(spark, whole):
    rows = [(i, t, 5, "clash") for i, t in enumerate(awkward())] + [(None, "no id", 5, "clash"), (7, "again", None, None), (7, "again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size int, doctree_text string").repartition(3)
    want = Counter((i, len((t or "").encode()), whole(t)) for i, t, *_ in rows)
    for most_sent in (token_counts.MOST_SENT, 20, 0):  # all pre-tokens sent, some, none
        assert Counter(map(tuple, token_counts.counted(docs, ["doc_id"], most_sent=most_sent).collect())) == want


def test_long_texts_are_cut_in_segments(monkeypatch, whole):
    monkeypatch.setattr(token_counts, "SEGMENT", 7)
    for text in awkward():
        found = token_counts.frequencies(text or "", PATH)
        assert sum(n * whole(token) for token, n in found.items()) == whole(text)


def test_other_columns_may_be_kept_and_tables_be_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.counted(docs, ["doc_id"]).count() == 0
    docs = spark.createDataFrame([(1, "two words", {"a": 1})], "doc_id bigint, text string, meta map<string,int>")
    assert token_counts.counted(docs, ["meta", "text"]).collect() == [({"a": 1}, "two words", 9, 2)]
    with pytest.raises(ValueError):
        token_counts.counted(docs.withColumnRenamed("doc_id", "n_tokens"), ["n_tokens"])


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.frequencies("text", public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_op11(spark, whole):
    rows = llm.QUERIES["op11_pre_token_counts"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := whole(r.text), n > 1024) for r in docs)
    assert Counter(map(tuple, rows)) == want

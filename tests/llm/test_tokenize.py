import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkprism.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")
PIECES = ["a", "b", "'", "re", "'ll", "s", " ", "  ", "\n", "\t", "1", "!", "é", "漢", "<|endoftext|>", " ", "🙂", "word", "\r\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.integers(1, 9))
def test_tree_equals_the_whole(text, leaf):
    t = T.tokenizer(leaf=leaf)
    assert t.encode(text) == t._bpe.encode_ordinary(text)
    assert t.decode(t.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(0, 80), st.integers(0, 80))
def test_join_is_associative(text, i, j):
    text = text.encode("utf-8", "ignore").decode()
    i, j = sorted((min(i, len(text)), min(j, len(text))))
    t = T.tokenizer()
    a, b, c = (t._encode(x) for x in (text[:i], text[i:j], text[j:]))
    assert t.join(t.join(a, b), c).ids == t.join(a, t.join(b, c)).ids == t._bpe.encode_ordinary(text)


def test_other_library_agrees():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    text = "It's   the reader’s <|endoftext|> 12.5 %\n\n漢字 🙂 " * 200
    assert T.tokenizer(leaf=100).encode(text) == ref.encode(text, add_special_tokens=False).ids


def test_columns(spark):
    rows = [(1, "hello world", 9), (2, "", 9), (3, None, 9), (4, " ", 9), (5, "x y " * 50_000, 9)]
    df = T.counted(T.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int"), "text"), "text")
    got = {r["doc_id"]: r for r in T.decoded(df, "ids").collect()}
    assert got[2]["ids"] == got[3]["ids"] == [] and got[2]["n_tokens"] == 0 and len(got[1]["ids"]) == 2
    assert all(got[i]["decoded_text"] == (t or "") for i, t, _ in rows) and got[5]["n_tokens"] == len(got[5]["ids"])
    assert T.encoded(df.select("text").limit(0), "text").count() == 0

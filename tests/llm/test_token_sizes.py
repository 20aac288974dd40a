import os

import pytest

from factloom.llm import token_sizes as TS

pytestmark = pytest.mark.skipif(not os.path.exists(TS.VOCABULARY), reason="no vocabulary file here")


def test_counts(spark, monkeypatch):
    e = TS.encoding(TS.VOCABULARY)
    text = "Rolled fetu-cache back to 3.2; lock looks über again.\nnext <|endoftext|> line " * 50
    assert TS.count(text) == len(e.encode_ordinary(text)) and e.decode(e.encode_ordinary(text)) == text
    whole = TS.count(text * 3)
    monkeypatch.setattr(TS, "PIECE", 500)
    assert TS.count(text * 3) == whole
    assert TS.count(None) == TS.count("") == 0
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (2, "", 7)], "id bigint, text string, n_tokens bigint").drop("n_tokens")
    assert sorted(tuple(r) for r in TS.token_sizes(df, id="id", text="text").collect()) == [(1, 2), (2, 0), (2, 0)]

from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from quillstone.llm import bpe, q_bpe
from tests.llm.rows import ODD, table

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_tiktoken(spark, reference):
    got = {r["doc_id"]: r for r in bpe.round_trip(table(spark, ODD), PATH, P.PATTERN).collect()}
    for k, text in enumerate(ODD):
        assert got[k]["ids"] == reference.encode_ordinary(text or "")
        assert bytes(got[k]["decoded"]) == (text or "").encode()


def test_odd_texts(reference):
    own = bpe.tokenizer(PATH, P.PATTERN)
    for text in ["a" * 20_000, "▁ ▁▁", "<unk><s>", "​­", "".join(map(chr, range(1, 900))), "  \n\n x", "'S 's"]:
        assert own.encode(text) == reference.encode_ordinary(text)


def test_query_columns_and_repeats(spark):
    df = table(spark, ["same", "same", None], [5, 5, None])
    rows = q_bpe.encode_documents(df).collect()
    assert len(rows) == 3 and {r["doc_id"] for r in rows} == {5, None}
    assert next(r for r in rows if r["doc_id"] is None)["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_decode_and_empty(spark):
    df = table(spark, ["héllo", ""])
    ids = bpe.round_trip(df, PATH, P.PATTERN).select("doc_id", "ids")
    assert {bytes(r["decoded"]) for r in bpe.decode(ids, PATH, P.PATTERN).collect()} == {"héllo".encode(), b""}
    assert q_bpe.encode_documents(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 1})

from __future__ import annotations

import collections

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quillstone.llm import bpe, mixing, toxicity
from quillstone.llm.common import read
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_ngram_join import brute


def test_every_stage_against_brute_force(spark, data):
    docs = read(spark, data, "documents")
    chain = toxicity.train(docs, read(spark, data, "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    step: dict[str, object] = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, data).cache()
        step[name] = now
        if name != "encode":
            assert now.columns == docs.columns

    clean = {i for i, t in rows.items() if not (p := chain.predict(t)) or p[-1] < chain.threshold}
    assert {r["doc_id"] for r in step["toxicity"].collect()} == clean

    newest: dict[str, int] = {}
    for i in clean:
        newest[lowered(rows[i])] = max(i, newest.get(lowered(rows[i]), i))
    single = set(newest.values())
    assert {r["doc_id"] for r in step["exact_dedup"].collect()} == single

    ids = sorted(single)
    components, _ = brute([rows[i] for i in ids], ids)
    left = set(components.values())
    assert {r["doc_id"] for r in step["near_dedup"].collect()} == left

    mixed = collections.Counter(r["doc_id"] for r in step["mixing"].collect())
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(step["near_dedup"]).collect()}
    assert set(mixed) <= left and taken.keys() == left
    assert all(abs(mixed[i] - (k / n if n else 0)) <= 0.5 for i, (n, k) in taken.items())

    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = step["encode"].collect()
    assert collections.Counter(r["doc_id"] for r in out) == mixed
    assert all(r["n_tokens"] == len(reference.encode_ordinary(rows[r["doc_id"]] or "")) for r in out)


def test_run_is_registered(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is corpus_pipeline.run
    numbers = {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")}
    assert numbers == set(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5

import re
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from test_minhash import brute
from test_mixing import water

import corpus_pipeline as cp
from scenekiln.llm.bpe import read_ranks
from scenekiln.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "12 34 !!", "en", "src1", 8), (None, "the and of this with that from what", None, None, 35), (10_003, "the and of this with that from what", None, None, 35)], docs.schema)
    docs = materialize(docs.union(odd))
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "mixing", "bpe"]
    first = materialize(cp.language_id(spark, docs, SF))
    assert first.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in first.select("doc_id").collect()}
    assert gone == {10_001, 10_002} and {r.lang for r in first.filter("doc_id = 10003").collect()} == {"en"}
    second = materialize(cp.near_dedup(spark, first, SF))
    groups = brute([(r.doc_id, r.text) for r in first.select("doc_id", "text").collect()], 5)
    assert {r.doc_id for r in second.select("doc_id").collect()} - {None} == {i for i, (_, c) in groups.items() if i == c}
    assert second.filter("doc_id is null").count() == 1
    third = materialize(cp.mixing(spark, second, SF))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = defaultdict(int), defaultdict(int)
    for rows, into in ((second, before), (third, after)):
        for r in rows.collect():
            into[r.source] += size(r.text)
    want = water(before)
    assert all(after[s] == pytest.approx(want[s], abs=1) for s in before)
    last = cp.bpe(spark, third, SF)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((r.doc_id or -1, r.token_ids) for r in last.collect())
    assert got == sorted((r.doc_id or -1, enc.encode_ordinary(r.text)) for r in third.collect())
    assert all(r.intact for r in last.collect())


def test_run(spark):
    assert cp.ORACLE_SQL is None
    assert cp.run(spark, SF).count() > 50


def test_short_documents_in_a_learned_language_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = ["Dr. John Smith", "def foo(x): return x", "Quick xylophone jazz", "All rights reserved."]
    texts = short + ["日本語テキスト", "qzx", "qzx " * 400]
    odd = spark.createDataFrame([(10_000 + i, t, None, None, len(t)) for i, t in enumerate(texts)], docs.schema)
    out = cp.language_id(spark, materialize(docs.union(odd)), SF)
    assert {r.text for r in out.filter("doc_id >= 10000").collect()} == set(short)


def test_one_rule_at_every_length(spark):
    """What share of a text must be known rises with its length without a step, and clean text of any length stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    known = " ".join(r.text for r in docs.orderBy("doc_id").limit(20).collect()).split()
    strange = lambda n: " ".join(f"qx{chr(97 + i % 26)}zj" for i in range(n))
    texts = [(f"{kind}{n}", " ".join(known[:n]) if kind == "clean" else f"the of and {strange(n)}") for n in (3, 20, 33, 34, 60, 400) for kind in ("clean", "strange")]
    odd = spark.createDataFrame([(20_000 + i, t, None, name, len(t)) for i, (name, t) in enumerate(texts)], docs.schema)
    out = cp.language_id(spark, materialize(spark.read.parquet(f"{SF}/documents.parquet").union(odd)), SF)
    stay = {r.source for r in out.filter("doc_id >= 20000").collect()}
    assert {name for name, _ in texts if name.startswith("clean")} <= stay and not stay & {"strange60", "strange400"}

import base64
import hashlib
import random
import unicodedata

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenekiln.llm import bpe
from scenekiln.llm.bpe import NEWER, BpeOperator, Codec, StreamingDecoder, read_ranks
from scenekiln.llm.queries import op10_bpe

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, P.PATTERN)


def unlike() -> str:
    """Code points that the tokenizer library classes otherwise than `regex`; only those new to Python's table can differ."""
    unknown = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    found: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes((i,)): i for i in range(256)}, special_tokens={})
        found |= set(bytes(library.encode_ordinary(unknown)).decode()) ^ set(regex.findall(kind, unknown))
    return "".join(sorted(found))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, text):
    ids = codec.encode(text)
    assert ids == REF.encode_ordinary(text)
    decoder = StreamingDecoder(codec.transducer.tokens)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_letters_and_long_pieces(codec):
    rng = random.Random(1)
    for alphabet in ("abcdeéß", "aaab", "etaoin shrdlu", "日本語テキスト", "0123456789", "=-_#*"):
        for n in (1, 3, 17, 200, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert codec.encode(text) == REF.encode_ordinary(text)


def test_newer_letters(codec):
    ends = [[int(x, 16) for x in span.split("-")] for span in NEWER.split()]
    assert unlike() == "".join(chr(c) for a, b in ends for c in range(a, b + 1))
    for c in unlike()[::997]:
        text = f"ab{c}cd {c} 1{c}"
        assert codec.encode(text) == REF.encode_ordinary(text)


def test_decoder_holds_back_and_replaces(codec):
    tokens = {i: bytes((i,)) for i in range(256)}
    decoder = StreamingDecoder(tokens)
    assert decoder.feed([0xE2, 0x82]) == "" and decoder.feed([0xAC]) == "€"
    assert decoder.feed([0xF0, 0x9F]) == "" and decoder.finish() == "�"
    for data in (b"\xff\x80a", b"\xe0\x80\x80", b"\xc3", b"a\xed\xa0\x80b"):
        d = StreamingDecoder(tokens)
        assert "".join(d.feed([b]) for b in data) + d.finish() == data.decode("utf-8", errors="replace")


def test_operator(spark):
    op = BpeOperator(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [None, "", "Hello  world\n\n", "Hello  world\n\n", "x" * 50_000, "naïve ñ <|endoftext|>"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    rows = op.decode(op.encode(df)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        assert row.token_ids == REF.encode_ordinary(text or "") and row.decoded == (text or "")
    digests = df.select("doc_id", op.digest(op.ids("text")).alias("d")).orderBy("doc_id").collect()
    assert [r.d.decoded_sha256 for r in digests] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert op.encode(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", F.lit("mine").alias("__TEXT"), F.lit("too").alias("__text_"))
    out = op.encode(clash, intact_col="intact").orderBy("doc_id").collect()
    assert all((r["__TEXT"], r["__text_"], r.intact) == ("mine", "too", True) and r.token_ids == REF.encode_ordinary(t or "") for r, t in zip(out, texts))


def test_vocabularies_that_differ_in_two_ranks(spark, tmp_path):
    """A worker that is used again must not encode with the ranks of the vocabulary before."""
    step = len(RANKS) // 997
    a, b = [t for i, t in enumerate(sorted(RANKS)) if i % step and t[:1] == b" " and t[1:].isalpha() and t.isascii()][:2]
    other = RANKS | {a: RANKS[b], b: RANKS[a]}
    path = tmp_path / "other.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in sorted(other.items(), key=lambda x: x[1])))
    ops = [BpeOperator(spark, str(p), P.PATTERN) for p in (P.path("byte_bpe_50k.tiktoken"), path)]
    text = a.decode() + b.decode()
    df = spark.createDataFrame([(text,)], "text string").coalesce(1)
    first, second = (op.encode(df).first().token_ids for op in ops)
    assert ops[0].key != ops[1].key and first == [RANKS[a], RANKS[b]] and second == first[::-1]


def test_small_stores(monkeypatch):
    """What does not fit is made again: same ids, and no more kept than the bounds say."""
    for name in ("MOVE_SLOTS", "STATE_SLOTS"):
        monkeypatch.setattr(bpe, name, 256)
    monkeypatch.setattr(bpe, "STORE_BYTES", 10_000)
    monkeypatch.setattr(bpe, "LISTED", 2_000)
    monkeypatch.setattr(bpe, "JOINED", 50)
    small, rng = Codec(RANKS, P.PATTERN), random.Random(2)
    for alphabet in ("abcdeéß ", "etaoin shrdlu", "日本語 テキスト", "0123456789 =-_#*\n"):
        text = "".join(rng.choice(alphabet) for _ in range(5000))
        assert small.encode(text) == REF.encode_ordinary(text)
        assert small.transducer.n_moves < 256 and len(small.transducer.last) < 256 and len(small.store) + len(small.store.older) <= 200


def test_query_against_library(spark):
    """op10_bpe over a whole table against the tokenizer library."""
    rows = {r.doc_id: r for r in op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        data = (doc.text or "").encode()
        ids = REF.encode_ordinary(doc.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        expected = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest())
        assert (rows[doc.doc_id].n_tokens, rows[doc.doc_id].ids_sha256, rows[doc.doc_id].decoded_sha256) == expected

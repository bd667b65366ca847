import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scenekiln.llm import langid
from scenekiln.llm.queries import op8_langid


def test_held_out_accuracy(spark):
    out = op8_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.filter("held_out").collect()
    assert len(rows) > 250 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé ,İß1") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + ["", "1 2", "x", "\ud800a"[1:]]
    grams = lambda t: [w[i : i + n] for n in (3, 4) for w in ("".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()) for w in [f" {w} "] for i in range(len(w) - n + 1)]
    hashed = lambda t: np.concatenate([h for p in langid._pieces(t) for h, _ in langid._grams(p)] or [np.empty(0, np.uint64)])
    known = [f"{a}{b}{c}" for a in "abc" for b in "abcd" for c in "ab"]
    profile = np.unique(np.concatenate([hashed(k) for k in known]))
    names = {g for k in known for g in grams(k)}
    model = langid.Profiles({"k": profile, "other": np.empty(0, np.uint64)}, rows=1 << 20)
    totals, hits = model.count(texts)
    assert totals.tolist() == [len(grams(t)) for t in texts]
    assert hits[:, 0].tolist() == [sum(g in names for g in grams(t)) for t in texts] and not hits[:, 1].any()


def test_many_languages_and_odd_rows(spark):
    words = {f"l{i:03d}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("qor", "zem", "ti", "nua")] for i in range(130)}
    rows = [(i * 10 + j, " ".join(w * 3), lang, "old") for i, (lang, w) in enumerate(words.items()) for j in range(3)]
    rows += [(9000, None, "l001", "old"), (9001, "123 !!", "l001", "old"), (None, "aaqor", None, "old"), (9002, "aazem " * 60_000, None, "old"), (9003, "x", None, "old"), (9003, "x", None, "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.learn(docs, F.lit(True))
    out = langid.identify(docs, model).collect()
    assert len(model[0].languages) == 130 and all(r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 9000)
    by = {r.doc_id: r for r in out}
    assert by[9000].lang_pred == by[9001].lang_pred == "und" and by[9000].score == 0 and by[9002].lang_pred == "l000" and by[9003].lang_pred in words
    none = langid.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0


def test_repeated_ids_and_texts_lose_no_language(spark):
    """The draw goes by texts, by one rule at every size: neither one id nor one text in most rows hides a language."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    text = lambda letters: " ".join(word(letters) for _ in range(12))
    for repeated in range(8):
        rows = [(repeated, text("abcde"), "aa") for _ in range(3000)] + [(100 + i, text("mnopq"), "mm") for i in range(3000)]
        rows += [(repeated, text("uvwxy"), "uu"), *[(repeated, "zuzu zizi zazu", "zz")] * 3000]
        model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
        asked = spark.createDataFrame([(text("abcde"), "aa"), (text("mnopq"), "mm"), (rows[6000][1], "uu"), ("zazu zuzu", "zz")], "text string, want string")
        assert all(r.lang_pred == r.want and r.score > 0 for r in langid.identify(asked, model).collect())


def test_named_results_leave_columns_alone(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "mine", 7), (2, "", "en", "mine", 8)], "doc_id long, text string, lang string, lang_pred string, score int")
    out = langid.identify(docs, langid.learn(docs, F.lit(True)), pred_col="__p", score_col="__s").collect()
    assert [(r.lang_pred, r.score) for r in out] == [("mine", 7), ("mine", 8)] and [r["__p"] for r in out] == ["en", "und"]


def test_query_against_exact_sets(spark):
    """The registered query on a whole table, against sets of n-grams in plain Python instead of Bloom filters."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = lambda t: np.concatenate([h for p in langid._pieces(t or "") for h, _ in langid._grams(p)] or [np.empty(0, np.uint64)]).view(np.int64).tolist()
    out_of = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    texts = {}
    for r in docs:
        if r.text is not None and r.lang is not None and not out_of(r.doc_id):
            texts.setdefault(r.lang, set()).add(r.text)
    assert texts and max(map(len, texts.values())) <= langid.SAMPLE  # nothing is drawn here, all is learned
    profiles = {}
    for lang, some in texts.items():
        counts = Counter(g for text in some for g in set(grams(text)))
        profiles[lang] = set(sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE])
    got = {r.doc_id: r for r in op8_langid(spark, sf).collect()}
    assert len(got) == len(docs)
    clear = 0
    for r in docs:
        own, row = grams(r.text), got[r.doc_id]
        assert row.held_out == out_of(r.doc_id)
        if not own:
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        shares = sorted(((sum(g in p for g in own) / len(own), lang) for lang, p in profiles.items()), reverse=True)
        assert abs(row.score - shares[0][0]) < 0.05
        if shares[0][0] - shares[1][0] > 0.05:
            clear += 1
            assert row.lang_pred == shares[0][1]
    assert clear > 0.9 * len(docs)


def plain_grams(text):
    """n-grams of the whole text by Python's own strings, with word borders as spaces."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower().replace("ς", "σ")).split()
    return [w[i : i + n] for n in (3, 4) for w in (f" {x} " for x in words) for i in range(len(w) - n + 1)]


def test_long_texts_lose_no_gram(monkeypatch):
    rng = random.Random(8)
    letters = "abcdeéΣ"
    texts = ["".join(rng.choice(letters + " ,"[: rng.randint(0, 2)]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["".join(rng.choice(letters + " ") for _ in range(600_000)), "".join(rng.choice(letters) for _ in range(600_000))]
    for text in texts:
        monkeypatch.setattr(langid, "CHUNK", 1 << 18 if len(text) > 100 else rng.choice([1, 2, 3, 5, 17]))
        pieces = list(langid._pieces(text))
        got = Counter(h for p in pieces for some, _ in langid._grams(p) for h in some.tolist())
        monkeypatch.setattr(langid, "CHUNK", 1 << 30)
        (whole,) = langid._pieces(text)
        assert got == Counter(h for some, _ in langid._grams(whole) for h in some.tolist())
        want = Counter(plain_grams(text))
        assert sorted(got.values()) == sorted(want.values()) and sum(got.values()) == sum(want.values())


def test_draw_and_counts_where_the_sample_binds(spark, monkeypatch):
    """The texts drawn are those of smallest hash, and the profile is what plain Python counts in them."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(langid, "PROFILE", 50)
    (model,) = langid.learn(docs, F.lit(True), sample=20)
    drawn = [r.text for r in docs.select("text").orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30)), F.xxhash64("text")).limit(20).collect()]
    counts = Counter(g for t in drawn for g in set(plain_grams(t)))
    assert len(counts) > 100 and max(counts.values()) > 2
    least = sorted(counts.values(), reverse=True)[49]
    inner = [g for g in counts if len(g) == 3 and " " not in g]

    def known(gram):
        (piece,) = langid._pieces(gram)
        (hashes, at), *_ = langid._grams(piece)
        return bool(int(model.masks(hashes[at == 1])[0][0]) & 1)

    assert all(known(g) for g in inner if counts[g] > least) and any(counts[g] > least for g in inner)
    rare = [g for g in inner if counts[g] < least]
    assert sum(map(known, rare)) <= 0.05 * len(rare)


def test_draw_at_any_number_of_texts(spark):
    """No product overflows: a language of 1e10 distinct texts has a threshold, not an error."""
    under = lambda n, sample=500: min(langid.DRAWS, -(-2 * langid.DRAWS * sample // n))
    assert under(10**10) == 108 and under(10) == langid.DRAWS
    assert spark.range(1).select((F.pmod(F.xxhash64("id"), F.lit(langid.DRAWS)) < F.lit(under(10**10))).alias("x")).collect()


def test_more_languages_than_a_filter_holds(spark, monkeypatch):
    rows = [(i, f"{a}{b}{c}wort {a}{b}{c}satz", f"l{i:04d}") for i, (a, b, c) in enumerate((chr(97 + i % 26), chr(97 + i // 26 % 26), chr(97 + i // 676)) for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.identify(docs, langid.learn(docs, F.lit(True))).collect()
    monkeypatch.setattr(langid, "LANGUAGES", 70)
    filters = langid.learn(docs, F.lit(True))
    assert len(filters) == 5
    parted = langid.identify(docs, filters, grams_col="n").collect()
    assert {(r.doc_id, r.lang_pred) for r in parted} == {(i, lang) for i, _, lang in rows} == {(r.doc_id, r.lang_pred) for r in whole}
    assert all(r.n == len(plain_grams(r.text)) for r in parted)

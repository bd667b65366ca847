import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scenekiln.llm import mixing
from scenekiln.llm.mixing import Mix, permuted
from scenekiln.llm.queries import op4_mixing, op4_mixing_dealt

SF = "/root/testdata/sf0.001"


def test_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
        df = df.withColumn("back", permuted(F.col("p"), F.lit(n), F.lit(5), inverse=True))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.id == r.back for r in rows)


def water(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["ab", "é", "x-1"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n))
    out = [(i, text(rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", None, "Z"]), 0) for i in range(300)]
    return out + [(300, None, "a", 0), (301, "", "q", 0), (None, text(9), "a", 0), (7, "same words", "a", 0), (7, "same words", "a", 0), (303, text(5000), "b", 0), (304, "one", "tiny", 0)]


def test_taken(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    out = Mix(docs, block=16).taken().collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = water(sizes)
    assert sorted((r.doc_id or -1, r.size, r.source or "") for r in out) == sorted((-1 if i is None else i or -1, size(t), s or "") for i, t, s, _ in rows)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    again = Mix(docs.repartition(7), block=16).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert Mix(docs.limit(0)).taken().count() == 0


def test_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mix = Mix(docs, block=16)
    taken = {(r.doc_id, r.source, r.size): r.taken for r in mix.taken().filter("doc_id is not null and doc_id != 7").collect()}
    got = defaultdict(list)
    for r in mix.documents(docs).collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id].append(r.text)
    by_id = {i: (t, s) for i, t, s, _ in rows}
    for (i, s, size), n in taken.items():
        assert sum(len(t.split()) for t in got[i]) == n and len(got[i]) <= 2
        words = (by_id[i][0] or "").split()
        for t in got[i]:
            it = iter(words)
            assert all(w in it for w in t.split())


def test_shards_have_fixed_size(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mix = Mix(docs, block=16, per_shard=50)
    counts = [r["count"] for r in mix.slots().groupBy("shard").count().orderBy("shard").collect()]
    assert all(n == 50 for n in counts[:-1]) and 0 < counts[-1] <= 50


def test_slots_are_dealt_to_shards(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mix = Mix(docs, block=16, per_shard=50)
    slots = {(r.shard, r.slot): (r.source, r.take) for r in mix.slots().collect()}
    filled, by_doc = defaultdict(list), defaultdict(int)
    for r in mix.dealt().collect():
        filled[r.shard, r.slot].append(r)
        by_doc[r.doc_id] += r.words
    assert filled.keys() == slots.keys() and len({shard for shard, _ in filled}) > 1
    for k, own in filled.items():
        own.sort(key=lambda r: r["at"])
        assert (own[0].source, sum(r.words for r in own)) == slots[k] and {r.source for r in own} == {slots[k][0]}
        assert [r["at"] for r in own] == [sum(r.words for r in own[:i]) for i in range(len(own))]
    taken = defaultdict(int)
    for r in mix.taken().collect():
        taken[r.doc_id] += r.taken
    assert {i: n for i, n in taken.items() if n} == by_doc


def test_query_deals_to_shards(spark):
    """op4_mixing's words are those of the slots that its documents are dealt to, and shards hold their fixed number."""
    taken = {r.doc_id: r for r in op4_mixing(spark, SF).collect()}
    first, slots, words = {}, defaultdict(int), defaultdict(int)
    per_shard = defaultdict(set)
    for r in op4_mixing_dealt(spark, SF).collect():
        first[r.doc_id] = min(first.get(r.doc_id, r.shard), r.shard)
        slots[r.doc_id] += 1
        words[r.doc_id] += r.words
        per_shard[r.shard].add(r.slot)
    assert {i: (r.first_shard, r.slots, r.taken) for i, r in taken.items() if r.taken} == {i: (first[i], slots[i], words[i]) for i in first}
    assert all(r.first_shard is None and r.slots == 0 for r in taken.values() if not r.taken)
    assert [len(per_shard[k]) for k in sorted(per_shard)][:-1] == [1024] * (len(per_shard) - 1)


def test_clashing_columns_stay(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(i % 50 + 1)) for i in range(200)]
    clash = ("h", "size", "chunk", "n", "spans", "takes", "index", "a.b")
    docs = spark.createDataFrame([(i, t, "s", *[f"{c}{i}" for c in clash]) for i, t in enumerate(texts)], ["doc_id", "text", "source", *clash])
    out = Mix(docs, block=16).documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) > 100 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clash) and all(set(r.text.split()) <= set(texts[r.doc_id].split()) for r in rows)


def permuted_plainly(x, n, hashes):
    """Swap-or-not on one index; `hashes` has for each round the shift and the bit of every index."""
    for shift, bits in hashes:
        pair = (shift - x) % n
        x = pair if bits[max(x, pair)] else x
    return x


def test_registered_query_against_plain_python(spark):
    """op4_mixing's words by document: sources packed, quotas filled block by block, all in plain Python. Only hashes are Spark's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    h = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("h")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(0), "doc_id", "h"), F.lit(4096)))
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.chunk, r.h) for r in h.collect()]
    sizes = defaultdict(int)
    for _, s, n, _, _ in rows:
        sizes[s] += n
    want, taken = water(sizes), defaultdict(int)
    for source, size in sizes.items():
        quota, blocks = round(want[source]), -(-size // 256)
        times = [0] * size  # how often each word of the packed source is taken
        for k, words in ((0, min(quota, size)), (1, max(quota - size, 0))):
            (salt,) = spark.sql(f"SELECT xxhash64(0, {source!r}, '{k}')").first()
            hashed = spark.range(24).select(F.pmod(F.xxhash64(F.lit(salt), F.col("id").cast("int")), F.lit(blocks)).alias("shift"), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.xxhash64(F.lit(salt), F.col("id").cast("int"), x.cast("long")).bitwiseAND(1) == 1).alias("bits")).orderBy("id").collect()
            hashes, left, j = [(r.shift, r.bits) for r in hashed], words, 0
            while left > 0:
                at = permuted_plainly(j, blocks, hashes)
                block = range(at * 256, min(size, at * 256 + 256))
                for i in block[: min(len(block), left)]:
                    times[i] += 1
                left -= min(len(block), left)
                j += 1
        at = 0
        for doc_id, _, n, _, _ in sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[0], r[4])):
            taken[doc_id] += sum(times[at : at + n])
            at += n
    got = {r.doc_id: r.taken for r in op4_mixing(spark, SF).collect()}
    assert len(got) == len(rows) and got == {i: taken[i] for i in got}


def test_a_record_in_most_rows_is_one_row_in_a_window(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPY_RANGE", 100)
    rows = [(5, "one two three", "a")] * 2000 + [(i, "four five " * (i % 4), "a") for i in range(300)] + [(None, "six", None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = Mix(docs, block=16)
    packed = mix.packed().collect()
    assert len(packed) == len(rows)
    at = 0
    for r in sorted((r for r in packed if r.source == "a"), key=lambda r: (r.chunk, r.n)):  # numbers and words follow on each other
        assert r.offset == at
        at += r["size"]
    numbers = defaultdict(list)
    for r in packed:
        numbers[r.source, r.chunk].append(r.n)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
    out = mix.taken().collect()
    assert len(out) == len(rows) and abs(sum(r.taken for r in out if r.source == "a") - water({"a": at, None: 30})["a"]) <= 1
    assert sum(len(r.text.split()) for r in mix.documents(docs).collect()) == sum(r.taken for r in out)

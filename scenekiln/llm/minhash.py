"""Near-duplicate documents: b-bit MinHash for candidates, confirmed on full shingle sets.

1. One pass over the texts: words, shingles as 64-bit hashes, their distinct set, MinHash minima. Of each minimum the
   low four bits are kept and packed into six longs; band keys hash four whole minima each.
2. Documents with equal sets are one text from here on, found by a digest of the set and counted before the shuffle.
3. Texts that share a band key are in a bucket; a bucket's smallest member is its hub. Each member is paired with the
   hub, not with each other: a bucket of n gives n - 1 candidates. Packed signatures are compared by bit counts, and
   the share of equal minima, corrected for chance collisions, drops pairs that are far below the threshold.
4. Candidates are confirmed on full sets, and components are found by alternating star joins.
5. Buckets whose members are not all in one component yet get the rest, in tiles: members outside the hub's component
   are cut into blocks of bounded size, and each such block is compared with each other one and with each block of the
   members inside, first by signatures, then, for those members that are left, on full sets. A pair is compared only in
   the first band it shares, and not once its components have met; a tile gives the links that join components, never
   all pairs. So a link between texts that share a band is never lost, whatever the bucket's size.

A hot bucket, star or group of copies is one key of a join. Such joins are merge joins of shuffled sides, whose rows
Spark's adaptive execution deals to several tasks where a key is hot; texts are fetched by the pair's other member first,
so that a hub's text meets its pairs last and is never shuffled once a pair.

Two sets of similarity 0.8 share none of the 24 bands with probability 3e-6, and fall under the estimate's margin with
probability 2e-6; that is the method's only loss. Nothing is collected but counts.

Rows: a null or empty text, or one of white space, has an empty set and is linked with nothing; a null doc_id belongs to
no group and is kept; repeated rows are copies of one document and get equal results, of which `kept` leaves one, as it
does of rows without a doc_id that have one set; rows of one doc_id with different
texts count as one node of the link graph where that doc_id stands for its text; an empty table gives no rows. Texts are
hashed in pieces of bounded memory; of a long text a worker holds the text and eight bytes for each of its words, a few
times over. The result has the columns named here, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.llm.worker import kept
from scenekiln.session import materialize, united

BANDS, ROWS, BITS = 24, 4, 4
MINIMA = BANDS * ROWS
LONGS = MINIMA * BITS // 64
#: How far below the threshold an estimate may be for the pair to be confirmed on full sets.
MARGIN = 0.2
#: Sets of ids up to this size (8 bytes each) are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_IDS = 500_000
#: Most members of a block of a bucket, and most shingles of one (a single long text may exceed them).
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 200_000
#: Rows that are taken from a batch and bytes of text that are hashed at once, shingles that are permuted at once.
CHUNK_ROWS, CHUNK_BYTES, CHUNK_SHINGLES = 256, 1 << 20, 2048

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_WORD, _SHINGLE, _BAND = (np.uint64(int(x) * 2 + 1) for x in _RNG.integers(1 << 61, 1 << 62, 3))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most CHUNK_BYTES, or of one row."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, last
        first = last


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z count as a-z; words end at ASCII white space."""
    for at in range(0, len(texts), CHUNK_ROWS):
        yield from _sets_of(texts.slice(at, CHUNK_ROWS).cast(pa.large_string()).fill_null(""), k)


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z as a-z, and which of them are not white space."""
    own = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return own, ~((own == 32) | ((own >= 9) & (own <= 13)))


def _word_sums(own: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The polynomial of each word that begins at `starts`."""
    at = np.arange(len(own)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(own)]))
    at[: starts[0]] = 0
    powers = np.multiply.accumulate(np.full(int(at.max()) + 1, _WORD))
    return np.add.reduceat(np.where(inside, (own.astype(np.uint64) + np.uint64(1)) * powers[at], np.uint64(0)), starts)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, in pieces; the sum of a word that a cut falls into is carried on."""
    parts, none = [], np.zeros(1, np.uint64)
    open_sum = shift = none  # shift: the power that the open word has come to
    for at in range(0, len(data), CHUNK_BYTES):
        own, inside = _lowered(data[at : at + CHUNK_BYTES])
        outside = np.flatnonzero(~inside)
        first = int(outside[0]) if len(outside) else len(own)
        if shift[0] and first:
            powers = np.multiply.accumulate(np.full(first, _WORD))
            open_sum = open_sum + shift * ((own[:first].astype(np.uint64) + np.uint64(1)) * powers).sum(dtype=np.uint64)
            shift = shift * powers[-1:]
            if first == len(own):
                continue
            own, inside = own[first:], inside[first:]
        if shift[0]:
            parts.append(mixed(open_sum))
            shift = none
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        starts = np.flatnonzero(opens)
        if len(starts):
            sums = _word_sums(own, inside, starts)
            if inside[-1]:
                open_sum, shift = sums[-1:], np.multiply.accumulate(np.full(len(own) - starts[-1], _WORD))[-1:]
                sums = sums[:-1]
            parts.append(mixed(sums))
    if shift[0]:
        parts.append(mixed(open_sum))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text's words."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    size = min(k, len(words))
    hashes = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        hashes *= _SHINGLE
        hashes += words[i : i + len(hashes)]
    return np.unique(mixed(hashes))


def _sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for first, last in _chunks(offsets):
        begins = offsets[first : last + 1] - offsets[first]
        if begins[-1] > CHUNK_BYTES:  # one text
            yield _shingles(_long_words(data[offsets[first] : offsets[last]]), k)
            continue
        own, inside = _lowered(data[offsets[first] : offsets[last]])
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = begins[:-1][begins[:-1] < len(own)]
        opens[edges] = inside[edges]
        starts = np.flatnonzero(opens)
        words_of = np.searchsorted(starts, begins)
        words = mixed(_word_sums(own, inside, starts)) if len(starts) else np.empty(0, np.uint64)
        for a, b in zip(words_of, words_of[1:]):
            yield _shingles(words[a:b], k)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed low bits of the minima, and the band keys, both as 64-bit values."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), CHUNK_SHINGLES):
        own = (shingles[None, at : at + CHUNK_SHINGLES] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        least = np.minimum(least, own.min(axis=1))
    low = mixed(least) & np.uint64(2**BITS - 1)
    packed = (low.reshape(LONGS, -1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = keys * _BAND + column
    return packed, mixed(keys)


def _features(k: int):
    @F.arrow_udf("struct<n:bigint,digest:binary,sig:array<bigint>,bands:array<bigint>>")
    def features(texts: pa.Array) -> pa.Array:
        kept("minhash")
        sizes, digests, sigs, bands = [], [], [], []
        for own in shingle_sets(texts, k):
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            packed, keys = signature(own)
            sigs.append(packed)
            bands.append(keys)
        many = lambda parts, n: pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)), n).cast(pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), many(sigs, LONGS), many(bands, BANDS)], ["n", "digest", "sig", "bands"])

    return features


def _linked(k: int, percent: int):
    @F.arrow_udf("boolean")
    def linked(first: pa.Array, second: pa.Array) -> pa.Array:
        kept("minhash")
        out = []
        for a, b in zip(shingle_sets(first, k), shingle_sets(second, k)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return linked


def _sets(k: int):
    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([own.tobytes() for own in shingle_sets(texts, k)], pa.binary())

    return sets


def near_pairs(rows: pd.DataFrame, least: float, percent: int) -> Iterator[tuple[int, int]]:
    """Places of the pairs of a tile that signatures leave: in different components, first met in this band."""
    band, sig, bands = int(rows["band"].iloc[0]), np.stack(rows["sig"]).astype(np.int64).view(np.uint64), np.stack(rows["bands"])
    n, comp, block = rows["n"].to_numpy(), rows["x"].to_numpy(), rows["block"].to_numpy()
    one = rows["lo"].iloc[0] == rows["hi"].iloc[0]
    first, second = (np.arange(len(rows)),) * 2 if one else (np.flatnonzero(block == rows["lo"].iloc[0]), np.flatnonzero(block == rows["hi"].iloc[0]))
    for at in range(0, len(first), 64):
        own = first[at : at + 64]
        unequal = np.zeros((len(own), len(second)), np.int64)
        for i in range(LONGS):
            x = sig[own, i][:, None] ^ sig[second, i][None]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            unequal += np.bitwise_count(x & np.uint64(0x1111111111111111))
        chance = 2.0**-BITS
        near = ((1 - unequal / MINIMA) - chance) / (1 - chance) >= least
        near &= comp[own][:, None] != comp[second][None]
        near &= 100 * np.minimum(n[own][:, None], n[second][None]) >= percent * np.maximum(n[own][:, None], n[second][None])
        if one:
            near &= own[:, None] < second[None]
        for i in range(band):
            near &= bands[own, i][:, None] != bands[second, i][None]
        for i, j in np.argwhere(near):
            yield int(own[i]), int(second[j])


def tile_members(rows: pd.DataFrame, least: float, percent: int) -> pd.DataFrame:
    """The rows of a tile that are in any pair its signatures leave."""
    left = np.zeros(len(rows), bool)
    for i, j in near_pairs(rows, least, percent):
        left[i] = left[j] = True
    return rows[left]


def tile_links(rows: pd.DataFrame, least: float, percent: int) -> pd.DataFrame:
    """Links of a tile, confirmed on full sets, as far as they join components."""
    sets = [np.frombuffer(b, np.uint64) for b in rows["set"]]
    comp, rep = rows["x"].to_list(), rows["rep"].to_list()
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    out = []
    for i, j in near_pairs(rows, least, percent):
        x, y = find(comp[i]), find(comp[j])
        if x != y:
            a, b = sets[i], sets[j]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[y] = x
                out.append((rep[i], rep[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


TILE = ["band", "key", "lo", "hi"]


def _by_tile(df: DataFrame, use, schema: str, *args) -> DataFrame:
    """`use` on each tile, one after the other from sorted partitions. A task holds one tile, and its batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("minhash")
        held: list[pd.DataFrame] = []
        at = None
        for batch in batches:
            keys = batch[TILE].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if a == b:
                    continue
                key = tuple(keys[a])
                if key != at and held:
                    yield use(pd.concat(held) if len(held) > 1 else held[0], *args)
                    held = []
                at = key
                held.append(batch.iloc[a:b].reset_index(drop=True))
        if held:
            yield use(pd.concat(held) if len(held) > 1 else held[0], *args)

    return df.repartition(*TILE).sortWithinPartitions(*TILE).mapInPandas(run, schema)


def estimated(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: minima whose low bits agree, less those that agree by chance."""
    unequal = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(MINIMA))) - chance) / (1 - chance)


def limited(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join with distinct ids, broadcast only if they are few."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, how)


def ordered(kind: T.DataType) -> bool:
    """Whether values of the type have an order."""
    if isinstance(kind, T.ArrayType):
        return ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(ordered(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b) but those that are their component's smallest.

    Large-star and small-star joins in turn, each round written to the shared folder, until nothing changes.
    """
    same = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    met = lambda df, least: df.join(materialize(least, "least").hint("merge"), "u")  # noqa: E731  a hub's rows are dealt out
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    last = same(e)
    while last[0]:
        both = united(e, e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(met(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialize(small.select("x.*").filter("u != v").distinct(), "edges")
        now = same(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


class NearDuplicates:
    """Links and components of `docs` (doc_id, text); `k` words a shingle, linked from `percent` similarity."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, margin: float = MARGIN):
        if percent < 80:
            raise ValueError("the bands are laid out for a similarity of 0.8 or more")
        self.docs, self.k, self.percent, self.least = docs.select(F.col("doc_id").cast("long"), "text"), k, percent, percent / 100 - margin
        self.features = materialize(self.docs.select("doc_id", _features(k)("text").alias("f")).select("doc_id", "f.*"), "features")
        full = self.features.filter("n > 0 AND doc_id IS NOT NULL")
        self.texts = materialize(full.groupBy("digest", "n", "sig", "bands").agg(F.min("doc_id").alias("rep")), "texts")
        self.components = self._components()

    def _signed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose signatures come near the threshold."""
        sig = self.texts.select("rep", "sig")
        df = pairs.join(sig.toDF("a", "sa").hint("merge"), "a").join(sig.toDF("b", "sb"), "b")
        return df.filter(estimated(F.col("sa"), F.col("sb")) >= self.least).select("a", "b").distinct()

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are linked by their full sets."""
        pairs = materialize(pairs, "candidates")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = limited(self.docs, ids, "doc_id", "left_semi")
        df = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta").hint("merge"), "a")
        return materialize(df.filter(_linked(self.k, self.percent)("ta", "tb")).select("a", "b"), "links")

    def _components(self) -> DataFrame:
        banded = self.texts.select("rep", F.posexplode("bands").alias("band", "key"))
        hubs = banded.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
        members = materialize(banded.join(materialize(hubs, "hubs").hint("merge"), ["band", "key"]).filter("rep != hub"), "buckets")
        links = self._confirmed(self._signed(members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()))
        found = components(links)
        comp = lambda at, name: found.select(F.col("node").alias(at), F.col("comp").alias(name))
        df = members.join(comp("rep", "x"), "rep", "left").join(comp("hub", "y").hint("merge"), "hub", "left")
        df = df.select("band", "key", "rep", F.coalesce("x", "rep").alias("x"), F.coalesce("y", "hub").alias("y"))
        df = materialize(df, "labelled")
        more = self._rest(df)
        if more.isEmpty():
            return found
        return components(united(links, more))

    def _rest(self, labelled: DataFrame) -> DataFrame:
        """Links (a, b) between members of different components that are in one bucket; those with hubs are known."""
        full = self.texts.select("rep", "n", "sig", "bands")
        open_ones = materialize(labelled.filter("x != y").select("band", "key").distinct(), "open")
        rows = labelled.join(open_ones.hint("merge"), ["band", "key"], "left_semi")
        rows = materialize(rows.select("band", "key", "rep", "x", (F.col("x") == F.col("y")).alias("main")).join(full, "rep"), "members")
        blocks = lambda own: F.greatest(F.ceil(F.count_if(own) / BLOCK_MEMBERS), F.ceil(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES))
        sizes = rows.groupBy("band", "key").agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains"), blocks(F.lit(True)).alias("all"), F.count("*").alias("c"))
        # a bucket that is one block stays one
        sizes = sizes.filter("c > 1").select("band", "key", "others", F.when(F.col("all") == 1, 0).otherwise(F.col("mains")).alias("mains"))
        rows = rows.join(materialize(sizes, "sizes").hint("merge"), ["band", "key"]).withColumn("main", F.col("main") & (F.col("mains") > 0))
        # blocks of members outside the hub's component come first; those inside are not compared with each other
        own = F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("rep"), "mains")).otherwise(F.pmod(F.xxhash64("rep"), "others"))
        upto = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
        rows = rows.withColumn("block", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
        rows = rows.select("band", "key", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "rep", "x", "n", "sig", "bands")
        schema = "band int, key long, lo long, hi long, block long, rep long, x long, n long, sig array<long>, bands array<long>"
        left = materialize(_by_tile(rows, tile_members, schema, self.least, self.percent), "tiles")
        ids = left.select(F.col("rep").alias("doc_id")).distinct()
        sets = limited(self.docs, ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), _sets(self.k)("text").alias("set"))
        return materialize(_by_tile(left.join(sets, "rep"), tile_links, "a long, b long", self.least, self.percent), "links")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every row."""
        comp = self.components.select(F.col("node").alias("rep"), "comp")
        named = self.texts.select("digest", "rep").join(comp, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
        alone = F.col("n") == 0
        full = self.features.filter(~alone & F.col("doc_id").isNotNull()).select("doc_id", "n", "digest").join(materialize(named, "named").hint("merge"), "digest", "left")
        out = united(full.select("doc_id", "n", "component_id"), self.features.filter(alone | F.col("doc_id").isNull()).select("doc_id", "n", "doc_id"))
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
        return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """`docs` without the documents that another one of their group stands for, and of rows that repeat a doc_id and
        a set of shingles only the smallest. Rows without an id are such repeats of each other by their set alone."""
        gone = self.result().filter("NOT kept").select("doc_id").distinct()
        rest = limited(docs, gone, "doc_id", "left_anti")
        again = self.features.filter("n > 0").groupBy("doc_id", "digest").agg(F.count("*").alias("c")).filter("c > 1")
        again = materialize(again.select("doc_id").distinct(), "repeated")
        if again.isEmpty():
            return rest
        named, ids = rest.filter("doc_id IS NOT NULL"), again.filter("doc_id IS NOT NULL")
        few = united(limited(named, ids, "doc_id", "left_semi"), rest.filter("doc_id IS NULL"))
        # columns of any type and name: the row is carried; its order is that of its columns, or of their text where they have none
        quoted = [F.col(f"`{c}`") for c in docs.columns]
        told = F.sha2(F.concat(*[F.coalesce(F.concat(F.lit("="), c.cast("string"), F.lit("\0")), F.lit("\0")) for c in quoted]), 256)
        few = few.select(F.struct(*quoted).alias("row"), F.struct(*[c.alias(f"c{i}") for i, (c, f) in enumerate(zip(quoted, docs.schema)) if ordered(f.dataType)], told.alias("told")).alias("at"), F.col("doc_id").alias("__id"), _features(self.k)("text").alias("f"))
        # a minimum, not a window: copies are thinned out before they are shuffled
        first = few.filter("f.n > 0").groupBy("__id", "f.digest").agg(F.min_by("row", "at").alias("row"))
        return united(limited(named, ids, "doc_id", "left_anti"), first.select("row.*"), few.filter("f.n = 0").select("row.*"))

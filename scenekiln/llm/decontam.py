"""Benchmark decontamination: an FM-index of words per training shard, searched backward for benchmark phrases.

A phrase is a window of N consecutive words of a benchmark item, or all words of a shorter item. Only stretches of words
that the benchmark knows, as long as the shortest phrase, can hold one. A training shard is what the texts of a batch have
of them, up to SHARD_WORDS words (a longer stretch is cut with N - 1 words in common), one after the other, each with an
end mark of its own. It is indexed:

* suffixes are sorted by packed first words, then by prefix doubling of what is still tied, to a full suffix array;
* the Burrows-Wheeler transform (the word before each suffix) becomes a wavelet matrix: a bit vector a level, with counts
  a block, so that how often a word comes before a row is found by a few bit counts;
* of the suffix array only every SAMPLED-th position of a stretch is kept.

All phrases are searched backward together, last words first; what is found is located by walking to the next sampled
position. Occurrences are merged to removal spans, in words and in bytes of the text, and phrases give the items.

Nothing is shuffled: the benchmark's phrases are broadcast, at most PASS_BYTES of item texts at once, and a larger benchmark
is searched in further passes whose spans are merged. Words are compared by 64-bit hashes; two different words of a pair
are taken for one with probability 5e-20.

Rows: a null text and one without words have no words, no spans and no items; null or wordless items have no phrases; an
item without an id marks words but is not listed; repeated rows and equal texts get equal results, whatever their ids; of
items that repeat an id each has its phrases and the id is listed once; an empty table or benchmark gives rows without
spans. Of a very long text a worker holds the text and twelve bytes for each of its words, and one shard's index. Columns
of the input named as the results are replaced; other columns stay (but for names that begin with two underscores).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenekiln.llm.minhash import mixed
from scenekiln.llm.worker import kept

#: Words of a phrase; item texts that are broadcast at once, in bytes.
WINDOW, PASS_BYTES = 10, 8 << 20
#: Bytes of texts that are tokenised at once, words of a shard at most.
CHUNK_BYTES, SHARD_WORDS = 1 << 22, 1 << 20
#: Every so many positions of a stretch are kept of the suffix array.
SAMPLED = 8
SPANS = "array<struct<first:bigint,end:bigint,from_byte:bigint,to_byte:bigint>>"
RESULTS = ("n_words", "spans", "items")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of UTF-8 bytes: digits, letters without regard to case, and what is not ASCII."""
    inside = _INSIDE[data]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    sizes = ends - starts
    own = _LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _BASE))
    own *= powers[np.arange(len(own)) - np.repeat(first, sizes)]
    return mixed(np.add.reduceat(own, first)), starts, ends


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a text of at most CHUNK_BYTES that cut no word; a longer word is in one range."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        if end < len(data):
            outside = np.flatnonzero(~_INSIDE[data[at:end]])
            if len(outside):
                end = at + int(outside[-1]) + 1
            while end < len(data) and _INSIDE[data[end - 1]] and _INSIDE[data[end]]:
                outside = np.flatnonzero(~_INSIDE[data[end : end + CHUNK_BYTES]])
                end = end + int(outside[0]) if len(outside) else min(end + CHUNK_BYTES, len(data))
        yield at, end
        at = end


@dataclass
class Phrases:
    """What a benchmark is looked for by: known words, phrases as places among them, and the items of each phrase."""

    vocabulary: np.ndarray
    #: One row a phrase, its words as places in `vocabulary` from 1, last word first, 0 after its first word.
    words: np.ndarray
    sizes: np.ndarray
    #: Items of phrase i: items[starts[i]:starts[i + 1]], places in `names`.
    starts: np.ndarray
    items: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        hashed = [words_of(np.frombuffer((text or "").encode(), np.uint8))[0] for _, text in rows]
        vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *hashed]))
        found, owner = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for i, own in enumerate(hashed):
            size = min(window, len(own))
            if size:
                places = (np.searchsorted(vocabulary, own) + 1).astype(np.int32)
                each = np.zeros((len(own) - size + 1, window), np.int32)
                each[:, :size] = np.lib.stride_tricks.sliding_window_view(places, size)[:, ::-1]
                found.append(each)
                owner.append(np.full(len(each), i))
        words, which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel().astype(np.int64), np.concatenate(owner)]), axis=1)
        starts = np.searchsorted(pairs[0], np.arange(len(words) + 1))
        return cls(vocabulary, words, (words > 0).sum(axis=1), starts, pairs[1], [i for i, _ in rows])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of stretches in order. Zeros end stretches, the earlier one counts as smaller; the last symbol is one."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    reach = min(62 // bits, 8, n)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)  # open_: no end mark among the packed symbols so far
    for i in range(reach):
        key <<= bits
        key[: n - i] += np.where(open_[: n - i], symbols[i:], 0)
        open_[: n - i] &= symbols[i:] > 0
        open_[n - i :] = False
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    # what is equal up to an end mark goes by place
    closed = ~open_[order]
    tied = np.flatnonzero(closed & ~(new & np.r_[new[1:], True]))
    if len(tied):
        group = np.cumsum(new)[tied]
        order[tied] = order[tied][np.lexsort((order[tied], group))]
        new[tied] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.r_[new[1:], True]
    active = order[~alone]
    step = reach
    while len(active):
        pair = rank[active] * n + rank[active + step]
        at = np.argsort(pair)
        active, pair = active[at], pair[at]
        group = rank[active]
        fresh = np.r_[True, group[1:] != group[:-1]]
        slot = group + np.arange(len(active)) - np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))
        order[slot] = active
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank[active] = np.maximum.accumulate(np.where(new, slot, 0))
        active = active[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class _Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FmIndex:
    """Stretches of symbols from 1, each ended by a 0."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        order = suffix_array(symbols)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=top + 1))]  # rows before those that begin with a symbol
        own = symbols[order - 1]
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in range(top.bit_length() - 1, -1, -1):
            ones = (own >> shift) & 1 != 0
            self.levels.append((shift, _Bits(ones), n - int(ones.sum())))
            own = np.concatenate([own[~ones], own[ones]])
        # a symbol's rows on the last level begin where its row 0 is led to
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))
        ends = np.flatnonzero(symbols == 0)
        begins = np.r_[0, ends[:-1] + 1]
        offset = np.arange(n) - np.repeat(begins, ends + 1 - begins)
        marked = offset[order] % SAMPLED == 0
        self.marked, self.places = _Bits(marked), order[marked]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 != 0, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First row of what `symbol` makes of the rows from `at` on when it is put before them."""
        return self.first[symbol] + self._down(symbol, at) - self.base[symbol]

    def search(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, first row and end row of the phrases that occur; their words come last first."""
        which = np.arange(len(words))
        low, high = self.first[words[:, 0]], self.first[words[:, 0] + 1]
        for i in range(1, words.shape[1] + 1):
            there = low < high
            which, low, high = which[there], low[there], high[there]
            if i == words.shape[1] or not len(which):
                break
            more = np.flatnonzero(sizes[which] > i)
            symbol = words[which[more], i]
            low[more], high[more] = self.step(symbol, low[more]), self.step(symbol, high[more])
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows."""
        out, left, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            there = self.marked.get(rows)
            out[left[there]] = self.places[self.marked.rank(rows[there])] + walked
            left, rows = left[~there], rows[~there]
            at, symbol = rows, np.zeros(len(rows), np.int64)
            for shift, bits, zeros in self.levels:
                one, ones = bits.get(at), bits.rank(at)
                symbol |= one.astype(np.int64) << shift
                at = np.where(one, zeros + ones, at - ones)
            rows = self.first[symbol] + at - self.base[symbol]
            walked += 1
        return out


def stretches(symbols: np.ndarray, least: int, most: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of stretches without a 0, of `least` words or more, each followed by an end mark (place -1), and
    how many words and marks they are one after the other; longer ones than `most` are cut with window - 1 words in common."""
    edges = np.flatnonzero(np.diff(np.r_[False, symbols > 0, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    for i in np.flatnonzero(ends - starts > most)[::-1]:
        cuts = np.arange(starts[i], ends[i] - window + 1, most - window + 1)
        starts, ends = np.r_[starts[:i], cuts, starts[i + 1 :]], np.r_[ends[:i], np.minimum(cuts + most, ends[i]), ends[i + 1 :]]
    sizes = ends - starts + 1
    first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    place = np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)
    place[first + sizes - 1] = -1
    return place, sizes


def occurrences(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Place and number of each occurrence of a phrase among stretches, by an index of them."""
    index = FmIndex(symbols, len(phrases.vocabulary))
    which, low, high = index.search(phrases.words, phrases.sizes)
    many = high - low
    rows = np.arange(int(many.sum())) - np.repeat(np.r_[0, np.cumsum(many)[:-1]] - low, many) if len(which) else np.empty(0, np.int64)
    return index.locate(rows), np.repeat(which, many)


class _Found:
    """n_words, spans and items of texts that are taken in one after the other; their stretches are indexed a shard at a time."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.n = phrases, []
        self._least = int(phrases.sizes.min()) if len(phrases.sizes) else 0
        #: Of the open shard: symbols, and for each the text, the word, and the word's bytes.
        self._open: list[tuple[np.ndarray, ...]] = []
        self._size = 0
        #: Words in phrases (text, word, from, to), and phrases in texts.
        self._hit: list[np.ndarray] = []
        self._pairs: list[np.ndarray] = []

    def take(self, symbols: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Some texts: the symbols, byte starts and byte ends of all their words, and how many words each has."""
        before = len(self.n)
        self.n += sizes.tolist()
        if not self._least:
            return
        # a 0 between texts parts their stretches
        owner = np.repeat(np.arange(len(sizes)), sizes)
        parted = np.zeros(len(symbols) + len(sizes), symbols.dtype)
        parted[np.arange(len(symbols)) + owner] = symbols
        window = self.phrases.words.shape[1]
        place, run = stretches(parted, self._least, max(SHARD_WORDS, 2 * window), window)
        if not len(place):
            return
        begins = np.r_[0, np.cumsum(sizes)]
        text = np.searchsorted(begins[1:] + np.arange(len(sizes)), place, "right")
        text[place < 0] = 0
        at = np.where(place < 0, 0, place - text)
        rows = np.where(place < 0, 0, parted[place]), before + text, at - begins[text], starts[at], ends[at]
        first = 0
        edges = np.cumsum(run)
        while first < len(place):  # whole stretches up to the shard's size
            upto = int(edges[max(np.searchsorted(edges, first + SHARD_WORDS - self._size, "right") - 1, np.searchsorted(edges, first, "right"))])
            self._open.append(tuple(r[first:upto] for r in rows))
            self._size += upto - first
            first = upto
            if self._size >= SHARD_WORDS:
                self._index()

    def _index(self) -> None:
        """Search the open shard and close it."""
        if not self._open:
            return
        symbols, *of = (np.concatenate(p) for p in zip(*self._open))
        self._open, self._size = [], 0
        place, which = occurrences(symbols, self.phrases)
        if len(place):
            depth = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(depth, place, 1)
            np.add.at(depth, place + self.phrases.sizes[which], -1)
            self._hit.append(np.stack([o[np.cumsum(depth[:-1]) > 0] for o in of]))
            self._pairs.append(np.unique(np.stack([of[0][place], which]), axis=1))

    def finished(self) -> tuple[list[int], list[list[list[int]]], list[list[str]]]:
        """n_words, spans and items of all texts."""
        self._index()
        spans: list[list[list[int]]] = [[] for _ in self.n]
        names: list[list[str]] = [[] for _ in self.n]
        if self._hit:
            text, word, start, end = np.unique(np.concatenate(self._hit, axis=1), axis=1)
            new = np.r_[True, (text[1:] != text[:-1]) | (word[1:] != word[:-1] + 1)]
            first, last = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True])
            for t, *span in np.stack([text[first], word[first], word[last] + 1, start[first], end[last]], axis=1).tolist():
                spans[t].append(span)
            text, which = np.unique(np.concatenate(self._pairs, axis=1), axis=1)
            many = self.phrases.starts[which + 1] - self.phrases.starts[which]
            items = self.phrases.items[np.arange(int(many.sum())) - np.repeat(np.r_[0, np.cumsum(many)[:-1]] - self.phrases.starts[which], many)]
            for t, i in np.unique(np.stack([np.repeat(text, many), items]), axis=1).T.tolist():
                if self.phrases.names[i] is not None:
                    names[t].append(self.phrases.names[i])
        return self.n, spans, [sorted(set(x)) for x in names]

    def _symbols(self, hashes: np.ndarray) -> np.ndarray:
        known = self.phrases.vocabulary
        if not len(known):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at + 1, 0).astype(np.int32)

    def take_texts(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            begins = offsets[at : upto + 1] - offsets[at]
            if begins[-1] > CHUNK_BYTES:  # one text
                own = data[offsets[at] : offsets[upto]]
                parts = [(self._symbols(h), (s + a).astype(np.int32 if len(own) < 1 << 31 else np.int64), (e + a).astype(np.int32 if len(own) < 1 << 31 else np.int64)) for a, b in _cuts(own) for h, s, e in [words_of(own[a:b])]]
                symbols, starts, ends = (np.concatenate(p) for p in zip(*parts))
                self.take(symbols, np.array([len(symbols)]), starts, ends)
            else:
                # a byte that is in no word between texts, so that no word reaches over a border
                parted = np.zeros(int(begins[-1]) + upto - at, np.uint8)
                parted[np.arange(int(begins[-1])) + np.repeat(np.arange(upto - at), np.diff(begins))] = data[offsets[at] : offsets[upto]]
                hashes, starts, ends = words_of(parted)
                edges = begins[:-1] + np.arange(upto - at)
                text = np.searchsorted(edges, starts, "right") - 1
                self.take(self._symbols(hashes), np.bincount(text, minlength=upto - at), starts - edges[text], ends - edges[text])
            at = upto


def _search(docs: DataFrame, text_col: str, rows: list[tuple[str | None, str | None]], window: int) -> Column:
    """Struct of n_words, spans and items of each text, for the phrases of these items."""
    shared = docs.sparkSession.sparkContext.broadcast(Phrases.of(rows, window))

    @F.arrow_udf(f"struct<n_words:bigint,spans:{SPANS},items:array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        kept("decontam")
        coded = texts.dictionary_encode()  # equal texts are indexed once
        out = _Found(shared.value)
        out.take_texts(pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]))
        of = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
        counts, all_spans, all_items = out.finished()
        names = ("first", "end", "from_byte", "to_byte")
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in names]))), ("items", pa.list_(pa.string()))])
        made = pa.array([{"n_words": n, "spans": [dict(zip(names, s)) for s in spans], "items": items} for n, spans, items in zip(counts, all_spans, all_items)], kind)
        return made.take(pa.array(of))

    return found.asNondeterministic()(F.col(f"`{text_col}`"))


def _merged(spans: Column) -> Column:
    """Spans of several passes as spans that neither meet nor touch."""
    put = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["first"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(_joined(F.element_at(a, -1), s)))).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), put)


def _joined(a: Column, b: Column) -> Column:
    ends = [F.greatest(a[c], b[c]).alias(c) for c in ("end", "to_byte")]
    return F.struct(a["first"].alias("first"), ends[0], a["from_byte"].alias("from_byte"), ends[1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`docs` with n_words, spans (of words and of bytes, in order, none meets another) and items (their ids as strings, sorted)."""
    if window < 1:
        raise ValueError("a phrase has a word at least")
    item, words = F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text_col}`")
    items = benchmark.select(item.alias("item"), words.alias("words")).filter("words IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    # an item is in one pass whole; passes are even but for a single item that is larger
    dealt = items.withColumn("pass", F.pmod(F.xxhash64("item", "words"), F.lit(passes)))
    df = docs.drop(*RESULTS)
    for i in range(passes):
        rows = [(r.item, r.words) for r in dealt.filter(F.col("pass") == i).select("item", "words").distinct().collect()]
        df = df.withColumn(f"__found{i}", _search(docs, text_col, rows, window))
    parts = [F.col(f"__found{i}") for i in range(passes)]
    spans = parts[0]["spans"] if passes == 1 else _merged(F.concat(*[p["spans"] for p in parts]))
    items = parts[0]["items"] if passes == 1 else F.array_sort(F.array_distinct(F.concat(*[p["items"] for p in parts])))
    return df.withColumns({"n_words": parts[0]["n_words"], "spans": spans, "items": items}).drop(*[f"__found{i}" for i in range(passes)])


def without_spans(text: Column, spans: Column) -> Column:
    """The text less its spans; what stood around a span is joined by a space."""
    data = text.cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["to_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["from_byte"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, " "))

"""Language identification by language-bitmask n-gram filters.

Each language learned has a profile: the letter n-grams that occur in most of its training documents. All profiles are
kept in one bit-sliced Bloom filter: a row of it has a bit for each language, an n-gram sets its language's bit in three
rows, and the AND of an n-gram's three rows is the mask of all languages that contain it. A text's n-grams are looked
up, each language's hits are counted, the hits expected by chance from how full the language's slice is are taken off,
and the language with most left is the text's.

Learning takes a bounded sample: for each language the SAMPLE distinct texts of smallest hash, by one rule at every size:
a text whose hash is in twice the wanted share of the language's distinct texts (an estimate over all of them) goes into
the draw. Only the sample and counts of its n-grams are shuffled, and only the profiles (at most PROFILE n-grams a
language) come to the driver. A filter has at most LANGUAGES languages; more have further filters, each text is judged by
all of them, and as a language's share does not depend on others, the largest of all counts. Prediction is one pass over
whole texts with no shuffle; texts are worked through in pieces of bounded memory, of which each takes over the last
points of the one before, so that every n-gram of the text counts once, wherever it lies.

Rows: a null text and one without a letter give `und` with score 0, and so does every text if nothing was learned; ties
go to the first language by code point; repeated rows are judged alike and learned from once, whatever their ids; an empty table gives an empty table; rows with a
null id are never learned from. Columns of the input named as the results are replaced, other columns stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.llm.worker import kept
from scenekiln.session import materialize

#: Distinct texts a language that are learned from, n-grams of a profile, rows of the filter (a power of two).
SAMPLE, PROFILE, FILTER_ROWS = 500, 4000, 1 << 16
SIZES = (3, 4)
#: Languages of one filter.
LANGUAGES = 4096
#: Characters that are worked through at once.
CHUNK = 1 << 18
#: Rows that are judged at once; hashes of texts are drawn among so many.
OUT_ROWS, DRAWS = 256, 1 << 30


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


#: Marks points that a piece takes over from the one before, and the end of a piece that goes on.
_AGAIN, _CUT = np.uint64(1 << 32), np.uint64(1 << 33)


def _grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams of letters (0: a border of words), and where each begins.

    What lies wholly in points taken over was counted before, and what reaches over a cut is counted in the next piece.
    """
    marked = len(points) > 0 and points.max() >= _AGAIN
    for n in SIZES:
        if len(points) < n:
            continue
        parts = [points[i : len(points) - n + 1 + i] for i in range(n)]
        valid = np.logical_and.reduce([(p & ~_AGAIN) != 0 if marked else p != 0 for p in parts[1:-1]])
        if marked:
            valid &= np.logical_and.reduce([p < _CUT for p in parts]) & ~np.logical_and.reduce([p >= _AGAIN for p in parts])
        at = np.flatnonzero(valid)
        h = np.full(len(at), np.uint64(n))
        for p in parts:
            own = p[at] & ~_AGAIN if marked else p[at]
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own)
        yield h, at


def _letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of others than letters as one 0. A sigma at the end of a word is as any."""
    points = np.frombuffer(text.lower().replace("ς", "σ").encode("utf-32-le", errors="replace"), np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    return points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]] if len(points) else points


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The text's points with a 0 at both ends, in pieces."""
    held = np.zeros(0, np.uint64)
    for at in range(0, max(1, len(text)), CHUNK):
        own = _letters_of(text[at : at + CHUNK])
        before = held if at else np.zeros(1, np.uint64)
        if len(own) and len(before) and own[0] == 0 and before[-1] == 0:
            own = own[1:]
        last = at + CHUNK >= len(text)
        whole = np.concatenate([before, own])
        if last and (len(whole) == 1 or whole[-1] != 0):
            whole = np.append(whole, np.uint64(0))
        held = whole[-(max(SIZES) - 1) :]
        piece = whole.copy()
        if at:
            piece[: len(before)] |= _AGAIN
        yield piece if last else np.append(piece, _CUT)


class Profiles:
    """The bit-sliced filter of the languages' n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], rows: int = FILTER_ROWS):
        self.languages = sorted(profiles)
        self.words = -(-len(self.languages) // 64)
        self.slices = np.zeros((max(1, self.words), rows), np.uint64)
        for i, language in enumerate(self.languages):
            for at in self._rows(profiles[language]):
                np.bitwise_or.at(self.slices[i // 64], at, np.uint64(1 << (i % 64)))
        filled = np.array([((self.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.chance = filled**3

    def _rows(self, hashes: np.ndarray) -> list[np.ndarray]:
        last = np.uint64(self.slices.shape[1] - 1)
        return [((hashes >> np.uint64(s)) & last).astype(np.int64) for s in (0, 20, 40)]

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Per 64 languages, each n-gram's mask of the languages that contain it."""
        a, b, c = self._rows(hashes)
        return [s[a] & s[b] & s[c] for s in self.slices]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and each language's hits among them."""
        totals, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        group: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not group:
                return
            owner = np.repeat([i for i, _ in group], [len(p) for _, p in group])
            points = np.concatenate([p for _, p in group])
            for hashes, at in _grams(points):
                own = owner[at]
                totals[:] += np.bincount(own, minlength=len(texts))
                masks = self.masks(hashes)
                for i in range(len(self.languages)):
                    has = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) != 0
                    hits[:, i] += np.bincount(own[has], minlength=len(texts))
            group.clear()

        held = 0
        for i, text in enumerate(texts):
            for piece in _pieces(text):
                if held + len(piece) > CHUNK:
                    flush()
                    held = 0
                group.append((i, piece))
                held += len(piece)
        flush()
        return totals, hits

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, the corrected share of n-grams that it contains, and their number."""
        totals, hits = self.count(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), totals
        n = np.maximum(totals, 1)[:, None]
        share = np.clip((hits / n - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        named = [self.languages[b] if t else "und" for b, t in zip(best, totals)]
        return named, np.where(totals > 0, share[np.arange(len(texts)), best], 0.0), totals


@F.arrow_udf(T.ArrayType(T.LongType()))
def _distinct_grams(texts: pa.Array) -> pa.Array:
    kept("langid")
    out = []
    for text in texts:
        found = [h for piece in _pieces(text.as_py() or "") for h, _ in _grams(piece)]
        out.append(np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> list[Profiles]:
    """Filters of profiles from the labelled rows that `learnable` names, `sample` distinct texts a language at most."""
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    rows = docs.filter(learnable & lang.isNotNull() & F.col(f"`{id_col}`").isNotNull() & text.isNotNull())
    rows = rows.select(lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy("lang").collect()  # a row a language
    # texts are drawn by their hash; twice the share wanted of each language's distinct ones is cut out before any shuffle
    under = lambda n: min(DRAWS, -(-2 * DRAWS * sample // n)) if n else DRAWS
    sized = docs.sparkSession.createDataFrame([(r.lang, under(r.n)) for r in sizes], "lang string, under long")
    drawn = F.pmod("h", F.lit(DRAWS))
    few = rows.select("lang", "h").join(F.broadcast(sized) if len(sizes) <= 16 * LANGUAGES else sized, "lang").filter(drawn < F.col("under"))
    first = Window.partitionBy("lang").orderBy(drawn, "h")
    chosen = few.select("lang", "h").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample).select("lang", "h")
    # at most `sample` hashes a language; copies of a text become one before they are shuffled
    texts = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    grams = texts.select("lang", F.explode(_distinct_grams("text")).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= PROFILE).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    names = [r.lang for r in sizes]
    if len(names) > LANGUAGES:
        best = materialize(best, "profiles")
    filters = []
    for at in range(0, max(1, len(names)), LANGUAGES):
        own = names[at : at + LANGUAGES]
        found = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in best.filter(F.col("lang").between(own[0], own[-1]) if own else F.lit(False)).collect()}
        filters.append(Profiles({name: found.get(name, np.empty(0, np.uint64)) for name in own}))
    return filters


def _judge(spark: SparkSession, profiles: Profiles):
    shared = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<score:double,lang_pred:string,n:bigint>")
    def judged(texts: pa.Array) -> pa.Array:
        kept("langid")
        named, score, grams = [], [], []
        for at in range(0, len(texts), OUT_ROWS):
            some, shares, totals = shared.value.decide([t or "" for t in texts.slice(at, OUT_ROWS).to_pylist()])
            named += some
            score += shares.tolist()
            grams += totals.tolist()
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(named, pa.string()), pa.array(grams, pa.int64())], ["score", "lang_pred", "n"])

    return judged.asNondeterministic()  # a filter on the result would else be pushed below it and judge each text twice


def identify(docs: DataFrame, filters: list[Profiles], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", grams_col: str | None = None) -> DataFrame:
    """`docs` with the language in `pred_col`, its score in `score_col` and, if it is named, the n-grams in `grams_col`."""
    each = [f"__judged{i}" for i in range(len(filters))]
    df = docs
    for name, profiles in zip(each, filters):
        df = df.withColumn(name, _judge(docs.sparkSession, profiles)(F.col(f"`{text_col}`")))
    best = F.col(each[0])
    for name in each[1:]:  # filters are in the order of their languages, so the first of equals stays
        best = F.when(F.col(f"{name}.score") > best["score"], F.col(name)).otherwise(best)
    out = {pred_col: best["lang_pred"], score_col: best["score"]} | ({grams_col: best["n"]} if grams_col else {})
    return df.withColumns(out).drop(*each)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))

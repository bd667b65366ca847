"""Mixing sources to target weights, in DataFrame operations only.

Each source is a stream of words (its documents in a fixed pseudorandom order) that is packed into blocks of `block`
words. The mix takes a quota of words from each source. A quota is filled by slots: slot j of a source takes the block
that the source's pseudorandom index permutation sends j to, pass after pass; the last one is cut so that the quota is
met to the word. One more permutation, over all slots, deals them to output shards, so that a shard's counts by source
are a multinomial draw conditioned on the quotas (independent draws would miss the targets by their variance).

A permutation of n indices is a swap-or-not shuffle: in each round x and (k - x) mod n are a pair that trades places if
a hash of the pair's larger member says so. It works for any n, needs no table, and is undone round by round.

Nothing here gathers a source in one task: documents are numbered within (source, chunk), those that repeat as one, only
sums of chunks are added up by source, slots and copies are made from bounded ranges, and words meet slots by a join on
(source, block).

Rows: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last one; repeated rows
are documents of their own; empty tables give empty tables; long texts span many blocks. Reruns agree, whatever the
partitions, as all draws are hashes of `seed`. Statistics carry the columns named here, and so no clashing ones;
`documents` gives the columns of its input, whatever their names (but for names that begin with two underscores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenekiln.session import materialize

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
ROUNDS, CHUNKS, SLOT_RANGE = 24, 4096, 4096
#: Copies of a record that are dealt out together.
COPY_RANGE = 4096
#: Up to so many sources their statistics are broadcast.
MAX_BROADCAST_SOURCES = 10_000


def _round(x: Column, r: Column, n: Column, salt: Column) -> Column:
    pair = F.pmod(F.pmod(F.xxhash64(salt, r), n) - x, n)
    return F.when(F.xxhash64(salt, r, F.greatest(x, pair)).bitwiseAND(1) == 1, pair).otherwise(x)


def permuted(x: Column, n: Column, salt: Column, inverse: bool = False) -> Column:
    """Where the permutation of 0..n-1 that `salt` names sends x; n is 1 at least."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, x.cast("long"), lambda at, r: _round(at, r, n.cast("long"), salt))


def targets(sources: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """`sources` (source, source_size) with weight and target.

    Weights repeat over the sources by code point, null last. A source that would pass `most` times its size stops
    there. Ordered by size over weight, those that stop come first, so each target follows from running sums. These
    windows go over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    df = sources.withColumn("weight", F.get(F.lit(list(weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("double"))
    df = df.withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("weight").over(rest))
    df = df.withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first that does not stop sets the level for all that follow
    level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    goes_on = F.min(F.col("stops").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return df.withColumn("target", F.when(goes_on, F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "weight", "target")


class Mix:
    """A mix of `docs`; the parts that several results need are written once to the shared folder."""

    def __init__(self, docs: DataFrame, block: int = 256, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, per_shard: int = 1024, seed: int = 0):
        self.block, self.per_shard, self.seed = block, per_shard, F.lit(seed)
        self.narrow = materialize(self._keyed(docs, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")), "mix-documents")
        sizes = self.narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = materialize(self._planned(targets(sizes, share, weights)), "mix-sources")
        self.few = self.sources.count() <= MAX_BROADCAST_SOURCES

    def _keyed(self, docs: DataFrame, size: Column) -> DataFrame:
        text = F.xxhash64("text")
        df = docs.select("doc_id", "source", text.alias("h"), size.alias("size"))
        return df.withColumn("chunk", F.pmod(F.xxhash64(self.seed, "doc_id", "h"), F.lit(CHUNKS)))

    def _planned(self, sources: DataFrame) -> DataFrame:
        """What a source's slots need: quota in words, blocks, size and place of its short last block, slots."""
        block = F.lit(self.block)
        df = sources.withColumn("quota", F.round("target").cast("long")).filter("source_size > 0")
        df = df.withColumn("blocks", F.ceil(F.col("source_size") / block))
        df = df.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
        for k in ("0", "1"):  # the two passes
            df = df.withColumn(f"at{k}", permuted(F.col("blocks") - 1, F.col("blocks"), self._salt(F.lit(k)), inverse=True))
        left = {"0": F.least("quota", "source_size"), "1": F.greatest(F.col("quota") - F.col("source_size"), F.lit(0))}
        for k, words in left.items():
            upto = F.col(f"at{k}") * block
            after = F.greatest(words - upto - F.col("short"), F.lit(0))
            df = df.withColumn(f"slots{k}", F.when(words <= upto, F.ceil(words / block)).otherwise(F.col(f"at{k}") + 1 + F.ceil(after / block)))
        df = df.withColumn("slots", F.col("slots0") + F.col("slots1"))
        names = Window.orderBy(F.col("source").isNull(), "source")
        return df.withColumn("first_slot", F.sum("slots").over(names) - F.col("slots"))

    def _salt(self, k: Column) -> Column:
        return F.xxhash64(self.seed, F.col("source"), k)

    def _with_sources(self, df: DataFrame, *cols: str) -> DataFrame:
        """Join on source, null included. A source may hold most rows: broadcast, else left to the skew join."""
        other = self.sources.select(F.col("source").alias("__s"), *cols)
        return df.join(F.broadcast(other) if self.few else other, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    def slots(self) -> DataFrame:
        """One row a slot: source, block index, words taken from its start, output shard and place there."""
        block = F.lit(self.block)
        ranges = F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / SLOT_RANGE)))
        df = self.sources.filter("slots > 0").withColumn("r", ranges)
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        # a number of partitions by the slots they will make: what is dealt out here is small only before
        df = df.repartition(1 + total // (4 * SLOT_RANGE), "source", "r").withColumn("i", F.explode(F.sequence(F.col("r") * SLOT_RANGE, F.least("slots", (F.col("r") + 1) * SLOT_RANGE) - 1)))
        second = F.col("i") >= F.col("slots0")
        j, at = F.when(second, F.col("i") - F.col("slots0")).otherwise(F.col("i")), F.when(second, F.col("at1")).otherwise(F.col("at0"))
        words = F.when(second, F.col("quota") - F.col("source_size")).otherwise(F.least("quota", "source_size"))
        df = df.withColumns({"j": j, "at": at, "words": words, "salt": self._salt(second.cast("int").cast("string"))})
        start = F.col("j") * block - F.when(F.col("j") > F.col("at"), block - F.col("short")).otherwise(0)
        size = F.when(F.col("j") == F.col("at"), F.col("short")).otherwise(block)
        df = df.withColumn("index", permuted(F.col("j"), F.col("blocks"), F.col("salt")))
        df = df.withColumn("take", F.least(size, F.col("words") - start))
        place = permuted(F.col("first_slot") + F.col("i"), F.lit(max(1, total)), F.xxhash64(self.seed))
        df = df.withColumn("place", place)
        return df.select("source", "index", "take", F.floor(F.col("place") / self.per_shard).alias("shard"), F.pmod("place", F.lit(self.per_shard)).alias("slot"))

    def packed(self) -> DataFrame:
        """One row a document with its number within (source, chunk) and its first word in the source.

        Records that repeat are counted before they are shuffled, and numbered and placed as one; what they stand for is
        dealt out again in ranges of copies, so that one record in most rows is one row in a window and many tasks after.
        """
        records = self.narrow.groupBy("source", "chunk", "doc_id", "h", "size").agg(F.count("*").alias("c"))
        before = Window.partitionBy("source", "chunk").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
        sums = {"n0": F.sum("c"), "inner": F.sum(F.col("size") * F.col("c"))}
        df = records.withColumns({k: F.coalesce(v.over(before), F.lit(0)) for k, v in sums.items()})
        chunks = self.narrow.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
        chunks = chunks.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("chunk")) - F.col("words"))
        chunks = chunks.select(F.col("source").alias("__s"), F.col("chunk").alias("__c"), "before")
        df = df.join(chunks.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("chunk") == F.col("__c")), "left").drop("__s", "__c")
        df = df.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPY_RANGE)))).repartition("source", "chunk", "doc_id", "h", "r")
        df = df.withColumn("k", F.explode(F.sequence(F.col("r") * COPY_RANGE, F.least("c", (F.col("r") + 1) * COPY_RANGE) - 1)))
        offset = F.col("before") + F.col("inner") + F.col("k") * F.col("size")
        return df.select("source", "chunk", "doc_id", "h", "size", (F.col("n0") + F.col("k") + 1).alias("n"), offset.alias("offset"))

    def spread(self) -> DataFrame:
        """One row a document and block it touches: the words [a, b) of the block."""
        block = F.lit(self.block)
        df = self.packed()
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)))
        df = df.withColumn("index", F.explode_outer(blocks))
        start = F.col("index") * block
        return df.withColumns({"a": F.greatest(F.col("offset"), start) - start, "b": F.least(F.col("offset") + F.col("size"), start + block) - start})

    def pieces(self) -> DataFrame:
        """`spread` with how often each word is taken."""
        df = self.spread()
        taken = self.slots().groupBy("source", "index").agg(F.sort_array(F.collect_list("take"), asc=False).alias("takes"))  # two at most
        taken = taken.select(F.col("source").alias("__s"), F.col("index").alias("__i"), "takes")
        df = df.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("index") == F.col("__i")), "left").drop("__s", "__i")
        return df.withColumn("takes", F.transform(F.coalesce("takes", F.array().cast("array<long>")), lambda t: F.greatest(F.least(t, F.col("b")) - F.col("a"), F.lit(0))))

    def dealt(self) -> DataFrame:
        """The mix as it is dealt: for each output shard and slot the documents whose words fill it, `first` the number in
        the document of the first of `words` words, `at` their place in the slot."""
        slots = self.slots().select(F.col("source").alias("__s"), F.col("index").alias("__i"), "take", "shard", "slot")
        df = self.spread().filter(F.col("index").isNotNull())
        df = df.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("index") == F.col("__i")))
        df = df.withColumn("words", F.least("take", "b") - F.col("a")).filter("words > 0")
        return df.select("shard", "slot", F.col("a").alias("at"), "source", "doc_id", (F.col("index") * self.block + F.col("a") - F.col("offset")).alias("first"), "words")

    def taken(self) -> DataFrame:
        """doc_id, size, source, source_size, target and taken of every document, summed over the slots that its words
        are dealt to: first_shard is the first output shard among them (null: none), slots their number."""
        slots = self.slots().select(F.col("source").alias("__s"), F.col("index").alias("__i"), "take", "shard")
        df = self.spread()
        df = df.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("index") == F.col("__i")), "left")
        df = df.withColumn("words", F.least("take", "b") - F.col("a")).withColumn("dealt", F.col("take").isNotNull() & (F.coalesce("words", F.lit(0)) > 0))
        sums = {"taken": F.coalesce(F.sum(F.when(F.col("dealt"), F.col("words"))), F.lit(0)), "first_shard": F.min(F.when(F.col("dealt"), F.col("shard"))), "slots": F.count_if("dealt")}
        df = df.groupBy("source", "chunk", "n", "doc_id", "size").agg(*[column.alias(name) for name, column in sums.items()])
        df = self._with_sources(df, "source_size", "target")
        return df.select("doc_id", "size", "source", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), *sums)

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: for the first and the second time that words of a document are taken, a row with the
        texts of those words, in their order and with the white space before each. n_chars, if there, is counted anew.
        """
        spans = []
        for k in (0, 1):
            length = F.coalesce(F.get("takes", F.lit(k)), F.lit(0))
            spans.append(F.struct(F.lit(k).alias("k"), (F.col("index") * self.block + F.col("a") - F.col("offset")).alias("from"), length.alias("n")))
        per = self.pieces().withColumn("s", F.explode(F.array(*spans))).filter("s.n > 0")
        per = per.groupBy("source", "chunk", "n", "s.k").agg(F.sort_array(F.collect_list(F.struct("s.from", "s.n"))).alias("spans"))
        per = per.select(F.col("source").alias("__s"), F.col("chunk").alias("__c"), F.col("n").alias("__m"), F.col("spans").alias("__spans"))
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
        keyed = docs.withColumns({"__h": F.xxhash64("text"), "__size": size})
        keyed = keyed.withColumn("__chunk", F.pmod(F.xxhash64(self.seed, "doc_id", "__h"), F.lit(CHUNKS)))
        within = Window.partitionBy("source", "__chunk").orderBy("doc_id", "__h", "__size")
        keyed = keyed.withColumn("__n", F.row_number().over(within))
        df = keyed.join(per.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__chunk") == F.col("__c")) & (F.col("__n") == F.col("__m")))
        words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
        cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["from"] + 1).cast("int"), s["n"].cast("int")))), "")
        whole = F.aggregate("__spans", F.lit(0).cast("long"), lambda t, s: t + s["n"]) == F.col("__size")
        df = df.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
        if "n_chars" in docs.columns:
            df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return df.select(*[F.col(f"`{c}`") for c in docs.columns])

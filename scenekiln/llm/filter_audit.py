"""Filter interaction audit: what each filter removes in every order of five, by CUBE over failure flags.

Documents are judged once: five failure flags each, counted by flags and part. A CUBE over the flags and the part sums
those counts for every set of flags; its rows whose chosen flags are all false (the others rolled up) say how many
documents survive a set of filters. A step of an order goes from one set to the same with one more filter, so each step
is a join of two such rows, and all that is asked for comes from survivors alone: what fails a filter, what it removes,
what an earlier one had removed, what only it catches, and its Shapley sum over all orders.

The failure conditions, on whole texts (null: empty; words: runs of what is not white space, case-sensitive):
A under 100 words; B distinct words under 80 % of all; C A-Z over 10 % of code points; D one of # $ % & * |; E the text of
a smaller id.

Texts are read in one pass and never shuffled: what is shuffled is an id, a 32-byte digest, the part and flags, counted
before each shuffle, so that copies, a hot id or a hot part cost one row a task. Labels are joined by id after that, by
merge, which Spark's adaptive execution splits where a key is hot. After the counts there are 32 rows a part, and a CUBE of
them.

Rows: null texts are empty ones and equal to each other; a null id is never smaller nor larger than another, so it does not
fail E, has no label, and is counted; repeated rows count each, and rows of one id and text do not fail E by each other; a
null part is the empty string, and so one with it; of labels that repeat an id one that says 1 is enough; an empty table
gives no rows. A text's words are held as an array while it is judged. Results have the columns named here, so other
columns of the input cannot clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenekiln.session import materialize

FILTERS = "ABCDE"
#: The bounds of the five filters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    sized = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"))), F.lit(0))
    capitals = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long")
    return {"words": sized, "C": 100 * capitals > MAX_CAPITALS * F.length(text), "D": text.rlike(SYMBOLS)}


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest and A to D of documents, and how many copies, rows that have them all."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    found = failures(F.col("t"))
    df = df.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), found["words"].alias("w"), found["C"].alias("C"), found["D"].alias("D"))
    df = df.select("id", "part", "digest", (F.col("w.n") < MIN_WORDS).alias("A"), (100 * F.col("w.d") < MIN_DISTINCT * F.col("w.n")).alias("B"), "C", "D")
    return df.groupBy("id", "part", "digest", *"ABCD").agg(F.count("*").alias("copies"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, A to E, and n, good, toxic: the documents with these flags, of which good and toxic ones."""
    flags = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{good_col}`") == 1).alias("good"), (F.col(f"`{toxic_col}`") == 1).alias("toxic"))
    flags = flags.filter("id IS NOT NULL").groupBy("id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    rows = judged(docs, id_col, text_col, part_col).join(flags.hint("merge"), "id", "left").fillna(False, ["good", "toxic"])
    # for each text and kind of row: all rows, those without an id, and the smallest id with its rows, so that a text that
    # most documents have is a few rows from here on
    named = F.col("id").isNotNull()
    own = rows.groupBy("digest", "part", "good", "toxic", *"ABCD").agg(
        F.sum("copies").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("copies"))).alias("unnamed"), F.min(F.when(named, F.struct("id", "copies"))).alias("least")
    )
    first = F.min("least.id").over(Window.partitionBy("digest"))
    stay = F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.copies")).otherwise(0)
    both = own.withColumn("stay", stay).select(
        "part", "good", "toxic", *"ABCD", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("stay").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("stay")).alias("n")))).alias("kind")
    )
    both = both.select("part", "good", "toxic", *"ABCD", "kind.*").filter("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return materialize(both.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), of("good"), of("toxic")), "cells")


def survivors(counted: DataFrame) -> DataFrame:
    """part (null: all parts), chosen (a set of filters as bits, A the highest) and the documents that pass them all.

    One CUBE over the cells; every set has its row, those that nothing passes as well.
    """
    cube = counted.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("rolled"))
    every = (1 << len(FILTERS)) - 1
    passed = F.lit(True)
    for f in FILTERS:
        passed = passed & ~F.coalesce(F.col(f), F.lit(False))
    found = cube.filter(passed).select("part", F.col("rolled").bitwiseAND(F.lit(1 << len(FILTERS))).alias("whole"), F.bitwise_not(F.col("rolled")).bitwiseAND(F.lit(every)).alias("chosen"), *COUNTS)
    parts = cube.filter(F.col("rolled").bitwiseAND(F.lit(every)) == every).select("part", F.col("rolled").bitwiseAND(F.lit(1 << len(FILTERS))).alias("whole"))
    grid = parts.withColumn("chosen", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(every).cast("long"))))
    out = grid.join(found.withColumnRenamed("part", "p").withColumnRenamed("whole", "q").withColumnRenamed("chosen", "s"), F.col("part").eqNullSafe(F.col("p")) & (F.col("whole") == F.col("q")) & (F.col("chosen") == F.col("s")), "left")
    return out.fillna(0, list(COUNTS)).filter("part IS NOT NULL OR whole > 0").select("part", "chosen", *COUNTS)


def _bit(f: str) -> int:
    return 1 << (len(FILTERS) - 1 - FILTERS.index(f))


def steps() -> list[tuple[str, int, str, int, int, int]]:
    """filter_order, step, its filter, the sets before and after it, and the filter alone: the 600 steps of 120 orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(order), i + 1, f, before, before | _bit(f), _bit(f)))
            before |= _bit(f)
    return out


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part (null: all parts together), filter_order, step and, of the step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, the step's filter's removed over all orders."""
    left = materialize(survivors(cells(docs, labels, **columns)), "survivors")
    plan = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, filter string, before long, after long, alone long")
    every = (1 << len(FILTERS)) - 1
    sets = lambda name: left.select(F.col("part").alias(f"{name}_part"), F.col("chosen").alias(f"{name}_set"), *[F.col(c).alias(f"{name}_{c}") for c in COUNTS])
    # pairs of sets: a filter is added to a set; the plan of 600 steps is broadcast to the rows before
    before, after = sets("b"), sets("a")
    pairs = before.join(F.broadcast(plan), F.col("b_set") == F.col("before"))
    pairs = pairs.join(after, F.col("b_part").eqNullSafe(F.col("a_part")) & (F.col("after") == F.col("a_set")))
    pairs = pairs.select(F.col("b_part").alias("part"), "filter_order", "step", "filter", "alone", F.col("a_n").alias("kept"), *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(d) for c, d in zip(COUNTS, ("removed", "good_lost", "toxic_lost"))])
    # of each filter: what fails it, and what fails it alone
    alone, none, others, all_ = sets("f"), sets("z"), sets("o"), sets("e")
    single = alone.join(none, F.col("f_part").eqNullSafe(F.col("z_part")) & (F.col("z_set") == 0) & F.col("f_set").isin([_bit(f) for f in FILTERS]))
    single = single.join(others, F.col("f_part").eqNullSafe(F.col("o_part")) & (F.col("o_set") == F.lit(every) - F.col("f_set")))
    single = single.join(all_, F.col("f_part").eqNullSafe(F.col("e_part")) & (F.col("e_set") == every))
    single = single.select("f_part", "f_set", (F.col("z_n") - F.col("f_n")).alias("fails"), (F.col("o_n") - F.col("e_n")).alias("unique_fails"))
    worth = pairs.groupBy(F.col("part").alias("s_part"), F.col("alone").alias("s_set")).agg(F.sum("removed").alias("shapley"))
    out = pairs.join(single, F.col("part").eqNullSafe(F.col("f_part")) & (F.col("alone") == F.col("f_set")))
    out = out.join(worth, F.col("part").eqNullSafe(F.col("s_part")) & (F.col("alone") == F.col("s_set")))
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")

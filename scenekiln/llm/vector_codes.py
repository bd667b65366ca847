"""Vector code compression: integer product quantisation, exact and the same for any partitioning.

Components are scaled and floored to integers, vectors are cut into PARTS equal parts, and each part has a codebook of at
most ENTRIES entries, which starts as that part of the vectors of smallest ids. A round assigns every part to its nearest
entry (squared Euclidean distance, ties to the lower index) and replaces each used entry by the floor of its parts' mean.

The codebooks are broadcast: ENTRIES vectors of integers, whatever the table's size. An Arrow batch computes all distances
by norm expansion, |x|^2 - 2 xc + |c|^2, as matrix products of integers: in doubles where no sum can reach 2^53, so that
they are exact and fast, and else in int64. A task adds up counts and sums by entry and gives one row for each block of
BLOCK positions of a used entry; those are summed by a grouped shuffle, and only the new codebooks come to the driver.

Vectors are read into integers once and written to the shared folder; a lost task is computed again from there. Codes are
written once as well, as the errors by label are a sum over them.

Rows: vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose components do
not make PARTS equal parts; floors beyond BOUND either way are held at it (a component of over 262,143 at scale 1024), so
that sums stay exact; vectors of another number of components have codebooks of their own; every row is coded, repeated
ones alike; an id that repeats starts one entry, from its smallest vector; a null id starts none; with fewer ids than
entries the codebooks are smaller, and if no id is there, empty, and nothing is coded; null labels are one label; an error
sum that no long holds is held at the largest; an empty table gives no rows. Other columns of the input are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenekiln.session import materialize, united

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest integer of a component either way: 2^28 - 1.
BOUND = (1 << 28) - 1
#: Positions of an entry whose sums are one row; rows of a batch whose distances are computed at once.
BLOCK, ROWS = 32, 4096
#: Labels whose sums are broadcast at most.
MAX_BROADCAST_LABELS = 100_000


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label and integers v of the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & (F.size("v") % PARTS == 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.greatest(F.lit(-BOUND - 1.0), F.least(F.lit(float(BOUND)), x * scale))
    return rows.filter(F.col("v").isNotNull() & fine).select("id", "label", F.transform("v", lambda x: F.floor(held(x)).cast("int")).alias("v"))


@dataclass
class Codebooks:
    """Entries by part: an int64 array (PARTS, entries, positions)."""

    entries: np.ndarray

    def products(self, part: int, x: np.ndarray) -> np.ndarray:
        """Exact products of the rows of x with the entries of a part."""
        own = self.entries[part]
        top = int(np.abs(x).max(initial=0)) * int(np.abs(own).max(initial=0)) * x.shape[1]
        if top < 1 << 53:  # every partial sum is an integer that a double holds
            return (x.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
        return x @ own.T

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part of each row of int64 vectors, the first of equals, and squared distances."""
        size = self.entries.shape[2]
        codes, far = np.empty((len(vectors), PARTS), np.int64), np.empty((len(vectors), PARTS), np.int64)
        for part in range(PARTS):
            x, own = vectors[:, part * size : (part + 1) * size], self.entries[part]
            d = (own * own).sum(axis=1)[None, :] - 2 * self.products(part, x)
            codes[:, part] = d.argmin(axis=1)
            far[:, part] = d[np.arange(len(x)), codes[:, part]] + (x * x).sum(axis=1)
        return codes, far

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(vectors: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for at in range(0, len(vectors), ROWS):
        yield np.asarray(vectors.slice(at, ROWS).flatten()).astype(np.int64).reshape(-1, dim)


def first_ids(rows: DataFrame, n: int = ENTRIES) -> list[int]:
    """The n smallest ids: of each task its own n smallest, then of all."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.int64)
        for batch in batches:
            own = np.unique(np.r_[own, np.asarray(batch.column(0).drop_null())])[:n]
        yield pa.record_batch({"id": pa.array(own, pa.int64())})

    return [r.id for r in rows.select("id").mapInArrow(smallest, "id long").distinct().orderBy("id").limit(n).collect()]


def start(rows: DataFrame, dim: int) -> Codebooks:
    """The codebooks that hold the vectors of smallest ids."""
    ids = first_ids(rows)
    first = rows.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if ids else []
    whole = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, dim // PARTS)
    return Codebooks(whole.transpose(1, 0, 2).copy())


def improved(rows: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """The codebooks after a round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    size = dim // PARTS
    blocks = -(-size // BLOCK)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value.entries.shape[1]
        counts, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, blocks * BLOCK), np.int64)
        for batch in batches:
            for x in _matrix(batch.column(0), dim):
                codes, _ = shared.value.assign(x)
                for part in range(PARTS):
                    own = codes[:, part]
                    counts[part] += np.bincount(own, minlength=entries)
                    order = np.argsort(own, kind="stable")
                    used, first = np.unique(own[order], return_index=True)
                    sums[part, used, :size] += np.add.reduceat(x[order, part * size : (part + 1) * size], first, axis=0)
        part, entry = np.nonzero(counts)
        for block in range(blocks):
            own = sums[part, entry, block * BLOCK : (block + 1) * BLOCK]
            columns = {"part": part, "entry": entry, "block": np.full(len(part), block), "n": counts[part, entry]} | {f"s{i}": own[:, i] for i in range(BLOCK)}
            yield pa.record_batch({c: pa.array(v.astype(np.int64)) for c, v in columns.items()})

    fields = ["part", "entry", "block", "n", *[f"s{i}" for i in range(BLOCK)]]
    found = rows.select("v").mapInArrow(summed, ", ".join(f"{c} long" for c in fields)).groupBy("part", "entry", "block")
    total = found.agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(BLOCK)])
    entries = books.entries.copy()
    for row in total.collect():  # ENTRIES vectors
        at = row.block * BLOCK
        own = [int(row[f"s{i}"]) // row.n for i in range(min(BLOCK, size - at))]
        entries[row.part, row.entry, at : at + len(own)] = own
    shared.unpersist()
    return Codebooks(entries)


def coded(rows: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """id, label, code and error."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("struct<code:string,error:bigint>")
    def assigned(vectors: pa.Array) -> pa.Array:
        codes, errors = [], []
        for x in _matrix(vectors, dim):
            own, far = shared.value.assign(x)
            text = own.astype(np.uint8).tobytes().hex()
            codes += [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            errors += far.sum(axis=1).tolist()
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

    return rows.select("id", "label", assigned("v").alias("c")).select("id", "label", "c.code", "c.error")


def compress(df: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, Codebooks]]:
    """vec_id, label, code, error and codebooks_sha256 of every row that takes part, and the codebooks by number of components."""
    rows = materialize(integers(df, id_col, vector_col, label_col), "integers")
    dims = [r.n for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # one number a kind of vector
    books, out = {}, []
    for dim in dims:
        own = rows.filter(F.size("v") == dim)
        found = start(own, dim)
        if not found.entries.shape[1]:
            continue
        for _ in range(rounds):
            found = improved(own, found, dim)
        books[dim] = found
        out.append(coded(own, found, dim).withColumn("codebooks_sha256", F.lit(found.sha256())))
    if not out:
        empty = rows.filter(F.lit(False)).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
        out.append(empty)
    return materialize(united(*out).withColumnRenamed("id", "vec_id"), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """`codes` with label_error, the error summed over equal labels, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = materialize(codes.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "__label")
    few = sums.count() <= MAX_BROADCAST_LABELS
    # beyond that a merge join, of which adaptive execution deals a hot label to several tasks
    return codes.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")

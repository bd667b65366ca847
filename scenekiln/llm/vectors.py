"""What both vector searches share: clean vectors dealt to shards, packed query blocks, and the merge of shard results.

Rows that repeat an id are merged first, so an id in most rows is one row; vectors are then dealt to shards of a bounded
size by a hash of their id; each shard becomes one row with its index. The
queries are packed into blocks of a bounded number of rows, and blocks are broadcast in groups of bounded bytes, one
group after the other, to the tasks that read the indexes: a stated query set against all rows, in blocks, for which
neither blocks nor indexes are copied through a shuffle. A task holds one group of blocks and one shard at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenekiln.llm.minhash import limited
from scenekiln.session import materialize, united

SHARD_ROWS, BLOCK_ROWS = 2048, 512
#: Bytes of query blocks that are broadcast at once (a single block may exceed them).
GROUP_BYTES = 16 << 20


def usable(df: DataFrame, id_col: str, vector_col: str, zero_ok: bool) -> DataFrame:
    """id and double vector v of the rows that take part: no null or non-finite component, not empty (nor zero)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.filter(~bad)
    return df if zero_ok else df.filter(F.exists("v", lambda x: x != 0))


def distinct_ids(rows: DataFrame) -> DataFrame:
    """Of rows with one id, the smallest vector of each dimension, so that no shard gets more than its share of an id.

    Repeated ids are found by ids alone; only their rows are merged, within each task before they are shuffled.
    """
    again = materialize(rows.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return rows
    few = limited(rows, again, "id", "left_semi").groupBy("id", F.size("v")).agg(F.min("v").alias("v"))
    return united(limited(rows, again, "id", "left_anti").select("id", "v"), few.select("id", "v"))


def by_dimension(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix for each dimension; of rows with equal ids the one with the smallest vector stays."""
    if len(pdf) == 0:
        return
    sizes = pdf["v"].map(len).to_numpy()
    for n in np.unique(sizes):
        own = pdf[sizes == n]
        ids, v = own["id"].to_numpy(np.int64), np.stack(own["v"].to_numpy()).astype(np.float64) + 0.0
        order = np.lexsort((*v.T[::-1], ids))
        ids, v = ids[order], v[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        yield ids[first], v[first]


Build = Callable[[np.ndarray, np.ndarray], object]
Search = Callable[[object, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def search(rows: DataFrame, is_query, k: int, build: Build, find: Search, score_type: str, prepare=lambda m: m) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best, ties to the smaller id.

    rows: id and v. `build(ids, matrix)` makes a shard's index of one dimension; `find(index, query ids, queries)` yields
    (query ids, ids, scores) of at least the k best of the shard for each query, the query's own id left out. `prepare`
    turns a matrix of the given components into the one that is indexed and asked.
    """
    rows = distinct_ids(rows)
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {m.shape[1]: build(ids, prepare(m)) for ids, m in by_dimension(pdf)}
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "index": [pickle.dumps(made)]})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pickle.dumps({m.shape[1]: (ids, prepare(m)) for ids, m in by_dimension(pdf)})], "b": [int(pdf["b"].iloc[0])]})

    # a number of partitions by the shards, so that each is a file and tasks read few of them
    indexes = materialize(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(built, "shard int, index binary"), "vector-index")
    asked = rows.filter(is_query)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    queries = materialize(asked.groupBy("b").applyInPandas(packed, "block binary, b int"), "vector-queries")
    groups, room = [[]], GROUP_BYTES
    for row in queries.select("b", F.octet_length("block").alias("n")).orderBy("b").collect():  # two numbers a block
        if groups[-1] and row.n > room:
            groups.append([])
            room = GROUP_BYTES
        groups[-1].append(row.b)
        room -= row.n
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for group in groups:
        shared = rows.sparkSession.sparkContext.broadcast([bytes(r.block) for r in queries.filter(F.col("b").between(group[0], group[-1]) if group else F.lit(False)).collect()])

        def found(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asks = [pickle.loads(b) for b in shared.value]
            for index in (i for batch in batches for i in batch["index"]):
                made = pickle.loads(index)
                for block in asks:
                    for dim, (ids, m) in block.items():
                        if dim in made:
                            hits = list(find(made[dim], ids, m))
                            if hits:
                                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*hits)))))

        best = indexes.select("index").mapInPandas(found, f"query_id long, vec_id long, score {score_type}")
        ranks = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        parts.append(materialize(ranks.select("query_id", "rank", "vec_id", "score"), "vector-best"))
        shared.unpersist()
    return united(*parts)

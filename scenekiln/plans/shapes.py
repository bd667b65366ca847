"""Driver tables read as the shapes this engine works on, in Spark and, for comparison, in DuckDB SQL.

Cards are order lines placed in the scene of their order; points and grids come from embeddings; shard members from
events and conversations; walked files from documents. No pixels are needed for any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenekiln.functions import geometry as g
from scenekiln.session import table

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, z, class, angle, scale, tx, ty, and `next`, these four numbers of the scene's next card (null: none). The part's
    brand joins by part key; then one shuffle by scene, of what the numbers are made of, serves all that goes by scene."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = lines.select("l_orderkey", *LINE_ORDER, "l_quantity", "l_discount", "l_tax").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    of = ("l_quantity", "l_discount", "l_tax", "l_partkey")
    lines = lines.withColumns({"z": F.row_number().over(w)} | {f"__{c}": F.lead(c).over(w) for c in of})

    def numbers(quantity: str, discount: str, tax: str, part: str) -> list[Column]:
        return [
            ((F.col(quantity) - 25.5) / 24.5 * 30).alias("angle"),
            (0.5 + 3 * F.col(discount)).alias("scale"),
            (-0.15 + 3.75 * F.col(tax)).alias("tx"),
            (-0.15 + 0.3 * (F.col(part) % 11) / 10.0).alias("ty"),
        ]

    later = F.when(F.col("__l_partkey").isNotNull(), F.struct(*numbers(*[f"__{c}" for c in of])))
    return lines.select(F.col("l_orderkey").alias("scene"), "z", F.col("p_brand").alias("class"), *numbers(*of), later.alias("next"))


def point_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and 32 points about the centre of the canvas."""
    e = lambda i: F.get(F.col("embedding"), i).cast("double")
    point = lambda i: F.struct((360 + 700 * e(2 * i)).alias("x"), (360 + 700 * e(2 * i + 1)).alias("y"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("points"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and an 8 x 8 gray grid."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: ((x.cast("double") + 1) * 127.5).cast("int")).alias("grid"))


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose key is the event type, in order of time, in one shard a user."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("shard"), "ts", "event_id", F.col("event_type").alias("key"), F.col("value").alias("payload"))


def chat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose sample is the conversation and whose ext is the role."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), F.col("role").alias("ext"), F.col("text").alias("payload"))


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four members a part, as the packer writes them: shard by size, class by brand."""
    roles = F.posexplode(F.array(*[F.lit(e) for e in ("cls", "png", "hull_hl.npy", "hull_lr.npy")])).alias("i", "ext")
    df = table(spark, sf_dir, "part").select(F.col("p_size").alias("shard"), "p_partkey", F.format_string("%08d", "p_partkey").alias("key"), "p_brand", "p_name", "p_type", "p_retailprice", roles)
    payload = F.when(F.col("ext") == "cls", F.concat(F.lit(" \t"), "p_brand", F.lit("\n"))).when(F.col("ext") == "png", F.col("p_name")).when(F.col("ext") == "hull_hl.npy", F.col("p_type")).otherwise(F.col("p_retailprice").cast("string"))
    return df.select("shard", "key", "ext", (F.col("p_partkey") * 4 + F.col("i")).alias("ord"), payload.alias("payload"))


def walked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and whether the file would decode; suffixes of both cases, some of no image."""
    ext = F.element_at(F.array(*[F.lit(e) for e in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.concat_ws("/", "source", "lang", "doc_id"), ext)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), (F.col("n_chars") >= 200).alias("decodes"))


SUFFIXES = (".png", ".JPG", ".jpeg", ".txt", ".WebP", ".bmp", "", ".tar.png")


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of orders: order, ord, area, hull area and centre in the corner zone."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    zone_w, zone_h = g.ZONE_X[1] - g.ZONE_X[0], g.ZONE_Y[1] - g.ZONE_Y[0]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("zone"),
        F.row_number().over(w).alias("ord"),
        F.col("l_quantity").alias("area"),
        (F.col("l_quantity") * (1 + 40 * F.col("l_discount"))).alias("hull_area"),
        (F.lit(float(zone_w)) * (F.col("l_partkey") % 21) / 20.0).alias("cx"),
        (F.lit(float(zone_h)) * (F.col("l_suppkey") % 21) / 20.0).alias("cy"),
    )


def deck(ranks: Column, suits: Column) -> Column:
    return F.concat(ranks, suits)


#: The same shapes in DuckDB SQL, as named parts of a WITH clause.
SQL = {
    "placements": f"""placements AS (
  SELECT l_orderkey AS scene, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})::INTEGER AS z, p_brand AS class,
    (l_quantity - 25.5) / 24.5 * 30 AS angle, 0.5::DOUBLE + 3 * l_discount AS scale, -0.15::DOUBLE + 3.75::DOUBLE * l_tax AS tx, -0.15::DOUBLE + 0.3::DOUBLE * (l_partkey % 11) / 10.0::DOUBLE AS ty
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "point_sets": """point_sets AS (
  SELECT vec_id, [{'x': 360 + 700 * embedding[2*i+1]::DOUBLE, 'y': 360 + 700 * embedding[2*i+2]::DOUBLE} FOR i IN range(0, 32)] AS points FROM embeddings)""",
    "grids": """grids AS (SELECT vec_id, [trunc((x::DOUBLE + 1) * 127.5::DOUBLE)::INTEGER FOR x IN embedding] AS grid FROM embeddings)""",
    "part_members": """part_members AS (
  SELECT p_size AS shard, printf('%08d', p_partkey) AS key, ext, p_partkey * 4 + i AS ord,
    CASE ext WHEN 'cls' THEN ' ' || chr(9) || p_brand || chr(10) WHEN 'png' THEN p_name WHEN 'hull_hl.npy' THEN p_type ELSE p_retailprice::VARCHAR END AS payload
  FROM part, (VALUES (0, 'cls'), (1, 'png'), (2, 'hull_hl.npy'), (3, 'hull_lr.npy')) r(i, ext))""",
    "walked": f"""walked AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || {list(SUFFIXES)}[doc_id % {len(SUFFIXES)} + 1] AS path, n_chars >= 200 AS decodes FROM documents)""",
    "contours": f"""contours AS (
  SELECT l_orderkey AS zone, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})::INTEGER AS ord, l_quantity AS area, l_quantity * (1 + 40 * l_discount) AS hull_area,
    {float(g.ZONE_X[1] - g.ZONE_X[0])}::DOUBLE * (l_partkey % 21) / 20.0::DOUBLE AS cx, {float(g.ZONE_Y[1] - g.ZONE_Y[0])}::DOUBLE * (l_suppkey % 21) / 20.0::DOUBLE AS cy FROM lineitem)""",
}

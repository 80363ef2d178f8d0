"""Shapes made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pdist

#: fixed values: the kinds that event types stand for.
KINDS = ("signup", "click", "view", "purchase", "error")
POINTS, WIDTH = 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree for each user: events in the order of time, the n-th below the n/2-th."""
    events = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    placed = events.select("user_id", n.alias("node_id"), kind.alias("structure_id"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (F.hour("ts") + F.minute("ts") / 60.0).alias("z"))
    return placed.select(F.col("user_id").cast("string").alias("cell_id"), "node_id", "structure_id", "x", "y", "z", F.lit(1.0).alias("radius"), F.when(F.col("node_id") == 1, F.lit(-1).cast("long")).otherwise((F.col("node_id") / 2).cast("long")).alias("parent_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, points): each vector as 16 points of 4 coordinates."""
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.slice("vector", i * WIDTH + 1, WIDTH))
    return vectors(spark, sf_dir).select("id", "label", points.alias("points"))


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, n, d, mass, kinds) with equal masses."""
    return clouds(spark, sf_dir).select("id", "label", F.lit(POINTS).alias("n"), pdist(F.col("points")).alias("d"), F.expr(f"transform(sequence(1, {POINTS}), x -> 1.0D / {POINTS})").alias("mass"), F.expr(f"transform(sequence(0, {POINTS - 1}), x -> x % 4 + 1)").alias("kinds"))


def weighted_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spaces() with masses that grow linearly with the number of the point."""
    return spaces(spark, sf_dir).withColumn("mass", F.expr(f"transform(sequence(1, {POINTS}), x -> x * 2.0D / {POINTS * (POINTS + 1)})"))


def icdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaces(spark, sf_dir).select(F.col("id").alias("cell_id"), "n", "d")


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (image_id, r, c, label, nucleus, signal): a disc for each part on its own 20 x 20 tile, ten tiles to an image."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), "p_size")
    grid = parts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(19))))
    away = (F.col("r") - 10) * (F.col("r") - 10) + (F.col("t") - 10) * (F.col("t") - 10)
    inside = 25 * away <= F.col("p_size") * F.col("p_size")
    placed = grid.select((F.col("k") / 10).cast("int").cast("string").alias("image_id"), "r", (F.col("t") + 20 * (F.col("k") % 10)).alias("c"), F.when(inside, F.col("k") + 1).otherwise(0).alias("label"), F.when(inside & (100 * away <= F.col("p_size") * F.col("p_size")), 1).otherwise(0).alias("nucleus"), F.when(inside, F.col("r") + 0.5 * F.col("t")).otherwise(0.0).alias("signal"))
    return placed


def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(modality, obj, vector): both halves of each vector."""
    v = vectors(spark, sf_dir)
    half = lambda n: v.select(F.lit(n).alias("modality"), F.col("id").alias("obj"), F.slice("vector", 1 + 32 * n, 32).alias("vector"))
    return half(0).unionByName(half(1))


#: Market segments, the points of a nation's space.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def nation_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, d, mass, kinds): a space of five points for each nation, its customers by market segment: (mean balance / 1000, customers / 4, place
    of the segment), where segments without customers are at (0, 0, place)."""
    customers = table(spark, sf_dir, "customer")
    point = F.struct(F.avg("c_acctbal").alias("balance"), F.count("*").alias("customers"))
    held = customers.groupBy("c_nationkey", "c_mktsegment").agg(point.alias("point")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "point"))).alias("of"))
    nations = table(spark, sf_dir, "nation").join(held, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    found = [F.try_element_at(F.col("of"), F.lit(s)) for s in SEGMENTS]
    points = F.array(*[F.array(F.coalesce(p["balance"] / 1000, F.lit(0.0)), F.coalesce(p["customers"] / 4, F.lit(0.0)), F.lit(float(k))) for k, p in enumerate(found)])
    n = len(SEGMENTS)
    return nations.select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("id"), F.lit(n).alias("n"), pdist(points).alias("d"), F.array(*[F.lit(1.0 / n)] * n).alias("mass"), F.array(*[F.lit(k % 3 + 1) for k in range(n)]).alias("kinds"))


def weighted_nation_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_spaces() with masses 1/15, 2/15, ... 5/15."""
    n = len(SEGMENTS)
    return nation_spaces(spark, sf_dir).withColumn("mass", F.array(*[F.lit((k + 1) * 2.0 / (n * (n + 1))) for k in range(n)]))

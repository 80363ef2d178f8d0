"""Expressions on condensed distance matrices (n(n-1)/2 entries above the diagonal, row by row) and other arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condensed_length(n: int) -> int:
    return n * (n - 1) // 2


def condensed_index(n: Column, i: Column, j: Column) -> Column:
    """0-based place of the pair i < j."""
    return (n * i - (i * (i + 1) / 2).cast("int") + j - i - 1).cast("int")


def uniform(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(1.0) / n)


def cap(values: Column, most: float) -> Column:
    return F.transform(values, lambda x: F.least(x, F.lit(float(most))))


def step_size(values: Column) -> Column:
    return F.array_min(values)


def is_sorted(values: Column) -> Column:
    """Whether an array never falls."""
    return F.coalesce(F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a <= b), lambda ok: ok), F.lit(True))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The length that the intervals [a, b] and [c, d] share."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def squared_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pdist(points: Column) -> Column:
    """Condensed Euclidean distances of an array of coordinate arrays."""
    rows = F.transform(F.sequence(F.lit(1), F.size(points)), lambda i: F.transform(F.slice(points, i + 1, F.greatest(F.size(points) - i, F.lit(0))), lambda q: euclidean(F.element_at(points, i), q)))
    return F.flatten(rows)


def plane(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """The isometry of the plane x + y + z = 1 onto two dimensions."""
    shift = (1 - 3**0.5) / 2
    return x + shift * z, y + shift * z


def matrix_entries(icdm: DataFrame) -> DataFrame:
    """(cell_id, i, j, d) with i < j from (cell_id, n, d)."""
    flat = icdm.select("cell_id", "n", F.posexplode("d").alias("k", "d"))
    # the row of place k: the largest i with n*i - i(i+1)/2 <= k
    root = F.floor((2 * F.col("n") - 1 - F.sqrt((2 * F.col("n") - 1).cast("double") * (2 * F.col("n") - 1) - 8 * F.col("k"))) / 2).cast("int")
    placed = flat.withColumn("i", root)
    return placed.select("cell_id", "i", (F.col("k") - F.col("n") * F.col("i") + (F.col("i") * (F.col("i") + 1) / 2).cast("int") + F.col("i") + 1).alias("j"), "d")


def square(icdm: DataFrame) -> DataFrame:
    """All entries (cell_id, i, j, d), both triangles and the diagonal."""
    upper = matrix_entries(icdm)
    diagonal = icdm.select("cell_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return upper.unionByName(upper.select("cell_id", F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(diagonal.select("cell_id", "i", F.col("i").alias("j"), F.lit(0.0).alias("d")))


def gather(distances: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row with the condensed array of pair distances in the order of names (a short list), all sorted names by default. A pair that isn't
    there raises an error."""
    if names is None:
        names = sorted({r.name for r in distances.select(F.explode(F.array("first", "second")).alias("name")).distinct().collect()})
    spark = distances.sparkSession
    order = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, place int")
    a, b = order.selectExpr("name a", "place i"), order.selectExpr("name b", "place j")
    pairs = a.join(b, F.col("i") < F.col("j")).withColumns({"first": F.least("a", "b"), "second": F.greatest("a", "b")})
    met = pairs.join(distances.select("first", "second", "dist"), ["first", "second"], "left")
    value = F.when(F.col("dist").isNull(), F.raise_error(F.concat(F.lit("no distance of "), "first", F.lit(" and "), "second")).cast("double")).otherwise(F.col("dist"))
    return met.withColumn("dist", value).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "dist"))), lambda s: s["dist"]).alias("d"))


def rename(distances: DataFrame, rule) -> DataFrame:
    """Pairs under new names, given by rule(column); pairs that fall together, or a pair of one name, raise an error."""
    renamed = distances.select(rule(F.col("first")).alias("a"), rule(F.col("second")).alias("b"), "dist")
    checked = renamed.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), F.when(F.col("a") == F.col("b"), F.raise_error(F.concat(F.lit("two names become "), "a")).cast("double")).otherwise(F.col("dist")).alias("dist"))
    merged = checked.groupBy("first", "second").agg(F.count("*").alias("n"), F.min("dist").alias("dist"))
    return merged.select("first", "second", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two pairs become "), "first", F.lit(" and "), "second")).cast("double")).otherwise(F.col("dist")).alias("dist"))

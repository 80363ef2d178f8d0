"""Distance tables, condensed distance matrices, couplings, meshes and settings, from files and to files."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import condensed_length
from ..storage import materialise


def canonical(pairs: DataFrame, a: str, b: str, dist: str) -> DataFrame:
    """(first, second, dist) with first < second."""
    return pairs.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.col(dist).cast("double").alias("dist"))


def read_distances(spark: SparkSession, path: str, header: bool = True, distinct: bool = False) -> DataFrame:
    """A CSV of at least three columns (name, name, distance); of rows for the same pair the last counts. distinct: the file is known to have each
    pair once, as one of all pairs has, so that rows needn't be shuffled to meet others of their pair."""
    rows = spark.read.csv(path, header=header)
    a, b, d = rows.columns[:3]
    if distinct:
        return canonical(rows, a, b, d)
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return placed.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.col(d).cast("double").alias("dist"), "place").groupBy("first", "second").agg(F.max_by("dist", "place").alias("dist"))


def names_of(distances: DataFrame) -> DataFrame:
    return distances.select(F.explode(F.array("first", "second")).alias("name")).distinct()


def symmetric(distances: DataFrame) -> DataFrame:
    """Both orders of each pair, and a zero for each name with itself."""
    order = lambda a, b: F.struct(F.col(a).alias("first"), F.col(b).alias("second"), F.col("dist").alias("dist"))
    both = distances.select(F.explode(F.array(order("first", "second"), order("second", "first"))).alias("p")).select("p.*")
    return both.unionByName(names_of(distances).select(F.col("name").alias("first"), F.col("name").alias("second"), F.lit(0.0).alias("dist")))


def write_distances(distances: DataFrame, path: str, compression: str = "none") -> None:
    distances.select(F.col("first").alias("first_object"), F.col("second").alias("second_object"), F.col("dist").alias("gw_distance")).write.csv(path, header=True, compression=compression)


def icdm_width(columns: list[str]) -> int:
    """The number of points of a condensed table by its header: cell_id, then n(n-1)/2 columns."""
    if not columns or columns[0] != "cell_id":
        raise ValueError("the header of a condensed table starts with cell_id")
    width = len(columns) - 1
    n = math.ceil(math.sqrt(2 * width))
    if condensed_length(n) != width:
        raise ValueError(f"{width} isn't n(n-1)/2 of any n")
    return n


def read_icdm(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, n, d) from a CSV of condensed matrices; rows whose first field starts with # are comments, and other values must be numbers."""
    rows = spark.read.csv(path, header=True, comment="#")
    n = icdm_width(rows.columns)
    return rows.select(F.col("cell_id"), F.lit(n).alias("n"), F.array(*[F.col(f"`{c}`").cast("double") for c in rows.columns[1:]]).alias("d"))


def write_icdm(icdm: DataFrame, path: str, n: int) -> None:
    """CSV with the columns cell_id, d_0_1, d_0_2 and so on, for matrices of n points."""
    names = [f"d_{i}_{j}" for i in range(n) for j in range(i + 1, n)]
    icdm.select("cell_id", *[F.element_at("d", k + 1).alias(c) for k, c in enumerate(names)]).write.csv(path, header=True)


def write_icdm_table(icdm: DataFrame, types: DataFrame | None, path: str) -> None:
    """Matrices, and the types of their points if given, in one Parquet table keyed by cell."""
    (icdm.join(types, "cell_id", "left") if types is not None else icdm).write.parquet(path)


def load_cells(spark: SparkSession, icdm_path: str, types: DataFrame | None = None) -> DataFrame:
    """Matrices with equal masses, and the points' types joined by cell rather than by position."""
    cells = read_icdm(spark, icdm_path).withColumn("mass", F.expr("array_repeat(1.0D / n, n)"))
    return cells.join(types, "cell_id") if types is not None else cells


def write_couplings(couplings: DataFrame, path: str) -> None:
    """Couplings may have any number of entries; masses are kept as float."""
    couplings.select("first", "second", "i", "j", F.col("mass").cast("float").alias("mass")).write.parquet(path)


def read_couplings(spark: SparkSession, path: str) -> DataFrame:
    """Couplings with first < second; where names are swapped, so are the points."""
    rows, turned = spark.read.parquet(path), F.col("first") > F.col("second")
    swap = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return rows.select(swap("first", "second").alias("first"), swap("second", "first").alias("second"), swap("i", "j").alias("i"), swap("j", "i").alias("j"), F.col("mass").cast("double").alias("mass"))


def read_obj(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of Wavefront files: only `v x y z` and `f a b c` lines count; faces become 0-based."""
    from .swc import stem, valid_name

    files = spark.read.text(folder, wholetext=True).withColumn("name", F.col("_metadata.file_name")).filter(valid_name(F.col("name"), ".obj"))
    lines = files.select(stem(F.col("name")).alias("cell_id"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    lines = materialise(lines.filter(F.element_at("f", 1).isin("v", "f")), "obj")
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("cell_id").orderBy("line")) - 1).cast("int")
    vertices = lines.filter("f[0] = 'v'").select("cell_id", place.alias("vid"), *[F.element_at("f", k + 2).cast("double").alias(c) for k, c in enumerate("xyz")])
    corner = lambda k: (F.split(F.element_at("f", k + 2), "/")[0].cast("int") - 1).alias(f"v{k}")
    return vertices, lines.filter("f[0] = 'f'").select("cell_id", place.alias("fid"), *[corner(k) for k in range(3)])


def write_settings(path: str, **settings) -> None:
    """The sidecar of image settings: a JSON file."""
    Path(path).write_text(json.dumps(settings))


def read_settings(path: str) -> dict | None:
    """Settings from a file, or from image_settings.json in a folder; None if there are none."""
    place = Path(path) / "image_settings.json" if Path(path).is_dir() else Path(path)
    return json.loads(place.read_text()) if place.exists() else None

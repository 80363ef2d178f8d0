"""What the operators of this package share: scratch tables, names, batches and graph components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, materialise, scratch_dir, scratch_path

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_BYTES", "ascii_lower", "bounded_batches", "components", "fresh", "join_counted", "join_sized", "let", "materialise", "row_keys", "running", "scratch_dir", "scratch_path", "table"]

#: Rows and bytes of one Arrow batch handed to a Python kernel, whichever is reached first (a single row may be larger).
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20
#: Keys that hold more than one of so many parts of all rows are hot: there are fewer of them than that. Up to HOT_FLOOR rows no key is.
HOT_PARTS, HOT_FLOOR = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that Python kernels get to BATCH_ROWS rows and BATCH_BYTES. Every kernel of this package asks for the same, so a
    plan that runs later meets the setting it was made under."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Tasks that equal keys are dealt to where a side is too large to be broadcast.
SALTS = 64


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], how: str, size: int) -> DataFrame:
    """Join (inner, left, left_semi or left_anti) with a written table of `size` bytes, which is broadcast if they are few. Otherwise both sides
    are shuffled by keys and salt: rows of left that share keys are dealt out by where they are read, and right is sent to all of them."""
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    salt = fresh(left, "salt")
    dealt = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(dealt, [*keys, salt], how).drop(salt)


#: Numbers of one block of running(): a block's results are copied for each number in it, so that the whole takes linear time.
RUN_BLOCK = 256


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """The array of step(...step(step(start, v1), v2)..., v(i-1)) for each i: what has been folded before each value. step is associative, and
    start its neutral element."""

    def scanned(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("now"), F.slice(F.array(first), 1, 0).alias("out"))
        walk = lambda acc, v: F.struct(step(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(block, begin, walk, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        folded = F.transform(blocks, lambda b: F.aggregate(b, start, step))
        # blocks of blocks: the firsts of all blocks are found the same way
        return let(_two_level(folded), lambda firsts: F.flatten(F.transform(blocks, lambda b, i: scanned(b, F.element_at(firsts, i + 1)))))

    def _two_level(folded: Column) -> Column:
        return let(_cut(folded), lambda outer: let(scanned(F.transform(outer, lambda b: F.aggregate(b, start, step)), start), lambda firsts: F.flatten(F.transform(outer, lambda b, i: scanned(b, F.element_at(firsts, i + 1))))))

    def _cut(array: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / RUN_BLOCK).cast("int")), lambda i: F.slice(array, i * RUN_BLOCK + 1, RUN_BLOCK))

    return F.when(F.size(values) > 0, let(_cut(values), joined)).otherwise(F.slice(F.array(start), 1, 0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does that for ASCII texts; others go through translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def row_keys(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row; equal rows have equal keys. A null leaves a hash as it is, so each column is hashed with
    whether it is null, and nested ones as JSON that spells nulls out. Map columns can't be hashed and are left out."""
    hashed: list[Column] = []
    for f in df.schema.fields:
        column, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if "map<" in kind or kind == "variant":
            continue
        nested = kind.startswith(("array<", "struct<"))
        hashed += [column.isNull(), F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"}) if nested else column]
    return [F.xxhash64(F.lit(1), *hashed), F.xxhash64(F.lit(2), *hashed)]


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join on `key` with a table that has one row a key and n, how many rows of `left` have it; rows is at least their number. The few hot
    keys (see HOT_PARTS) are broadcast, so their rows stay where they are; the others are shuffled."""
    if rows <= HOT_FLOOR:
        return left.join(right.drop(n), key)
    hot = F.col(n) > max(HOT_FLOOR, rows // HOT_PARTS)
    of_hot = F.broadcast(right.filter(hot).drop(n))
    rest = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(right.filter(~hot).drop(n), key)
    return left.join(of_hot, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with edges (u, v), both long: rows (u, v) with v the smallest node of u's component; nodes that are
    the smallest themselves have no row. The centre of a large star is a hot key, met by join_counted(). Alternates large-star and small-star steps, which needs rounds in the order of log(nodes); each round
    is written to the shared folder, and only two numbers of it come to the driver."""
    spark = edges.sparkSession

    def measured(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    now = measured(current)
    while now[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), least, "u", "n", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", "n", 2 * now[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current, before = materialise(small, "edges"), now
        now = measured(current)
        if now == before:
            break
    return current if now[0] else spark.createDataFrame([], "u long, v long")

"""What the training-data operators share: written tables, ranks without hot groups, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.names import unused  # noqa: F401
from tidemark.functions.workdir import shared_folder

BATCH_ROWS = 1000
#: A table of fewer bytes a core is dealt out before Python works on it.
SMALL_BYTES = 8 << 20
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a temporary one on a single machine."""
    return shared_folder(spark)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers: keep Arrow batches small unless the session has its own size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out to all cores; larger ones come in enough parts by themselves.

    A file of one row group is one task however many cores there are. The size is the plan's estimate.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * SMALL_BYTES else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_tidemark_path", None)
    if path is not None and path in _written:
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() makes, written; all other tables that were written for it are deleted."""
    before = set(_written)
    out = materialize(build(), label)
    for path in set(_written) - before - {out._tidemark_path}:
        _delete(path)
    return out


@atexit.register
def _release_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone already
            _written.pop(path, None)


def map_whole_rows(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch], drop: Sequence[str] = ()) -> DataFrame:
    """Rows with all their columns, but those to drop, through Python; columns may have any names, with dots too."""
    names, kept = df.columns, [i for i, c in enumerate(df.columns) if c not in drop]
    schema = T.StructType([T.StructField(f"c{i}", df.schema.fields[i].dataType) for i in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch.rename_columns(names)).select(kept).rename_columns(schema.names)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema).toDF(*(names[i] for i in kept))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def salts_for(n_rows: int, per_group: int = 100_000, least: int = 256) -> int:
    """How many salts keep a group of a third of n_rows below per_group rows a salt."""
    return max(least, -(-n_rows // per_group))


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt_by: Column, n_rows: int, name: str) -> DataFrame:
    """Gapless rank from 0 within keys. A group is dealt over salts, so no task holds a hot one.

    The rank orders rows by salt first, then by order; rows that tie fully are alike and may swap.
    """
    salt, base, inner = "__salt", "__base", "__inner"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts_for(n_rows))))
    counts = salted.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, salt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    ranked = salted.withColumn(inner, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)) - 1)
    return ranked.join(bases, [*keys, salt]).withColumn(name, (F.col(base) + F.col(inner)).cast("long")).drop(salt, base, inner)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node reachable over the edges (u, v) of longs; nodes without edges are absent.

    Alternating large-star and small-star rounds. Every round reads and writes tables in the shared folder; minima are
    partial aggregates. A hub, the least node of a large component, has all its edges on the side of the larger star's
    left join that AQE can split, and no row on the other.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    state = None
    while True:  # in every table u > v
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        stars = materialize(now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), label)
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where("u <> v").distinct(), label)
        release(stars)
        release(now)
        now = nxt
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (seen.n, seen.h) == state:
            break
        state = (seen.n, seen.h)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


class Generations:
    """A worker's bounded memory of computed values: two dictionaries, the older dropped when the newer is full.

    What is asked for again moves to the newer one, so frequent keys stay. Forgetting costs time only.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 500_000):
        self.compute, self.limit, self.new, self.old = compute, limit, {}, {}

    def many(self, keys: list) -> list:
        new, old = self.new, self.old
        missing = []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    missing.append(k)
        if missing:
            new.update(zip(missing, self.compute(missing), strict=True))
        found = [new[k] for k in keys]
        if len(new) > self.limit:
            self.new, self.old = {}, new
        return found


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])

"""What the operators share: reading a table, materialising in the shared folder, broadcasts of a checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of a few fixed-width columns is sent to every task (under 32 MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000

_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary folder in local mode, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if spark.sparkContext.master.startswith("local"):
            _local_dirs[app] = tempfile.mkdtemp(prefix="chronoloom-")
            atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        else:
            _local_dirs[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _local_dirs[app]


#: Paths in the shared folder that nobody has removed, by the application that writes them.
_written: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; sweep() removes it."""
    path = f"{scratch_dir(spark)}/chronoloom-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def spill(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(sc, path: str) -> None:
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    name = path.rpartition("/")[2]
    for paths in _written.values():
        paths -= {p for p in paths if p.endswith(name)}


def written(spark: SparkSession) -> set[str]:
    """Names of what this application has written in the shared folder and nobody has removed."""
    return {p.rpartition("/")[2] for p in _written.get(spark.sparkContext.applicationId, ())}


def sweep(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Removes all that this application has written in the shared folder but for the names in keep; results that haven't been written or read yet can't be read any more."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        if path.rpartition("/")[2] not in keep:
            _delete(spark.sparkContext, path)


@atexit.register
def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        sweep(spark)


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
ARROW_ROWS = 2000


def modest_batches(spark: SparkSession) -> None:
    """Sees to it that Arrow batches of the session have at most ARROW_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def forget(*tables: DataFrame) -> None:
    """Removes tables that spill() wrote, once nothing reads them any more. What isn't one of its tables stays."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if name.rpartition("/")[2].startswith("chronoloom-"):
                _delete(sc, name)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if a count shows that it is small; else the planner's shuffle join stands. df should be materialised."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uniform(*cols: str, seed: int = 0):
    """A number in [0, 1) that depends on the columns' values and the seed only."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def no_clash(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have (whatever the case of its letters)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


#: Ranges in which running() sums.
RANGES = 64


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with running sums (the row itself included) in the given order, which should be total. Rows are dealt to ranges of the order and written, the ranges'
    sums are added up, and each range is sorted by itself, so no task holds all rows. Columns of df of the sums' names give way."""
    part, own = no_clash(df, "range", "own_range")
    kept = [c for c in df.columns if c not in sums]
    dealt = spill(df.select(*kept, *(x.alias(n) for n, x in sums.items())).repartitionByRange(RANGES, *order).withColumn(part, F.spark_partition_id()), "ranges")
    per = dealt.groupBy(F.col(part).alias(own)).agg(*(F.sum(n).alias(f"{n}{own}") for n in sums))
    before = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    per = F.broadcast(per.select(own, *(F.coalesce(F.sum(f"{n}{own}").over(before), F.lit(0)).alias(f"{n}{own}") for n in sums)))
    upto = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(per, F.col(part) == F.col(own)).select(*kept, *((F.sum(n).over(upto) + F.col(f"{n}{own}")).alias(n) for n in sums))


#: Words of 64 bits of a filter (16 MB as a table that is sent to every task, whatever the input's size).
FILTER_WORDS = 1 << 20


class Filter:
    """Which values may be among keys' column: a bitmap of fixed size that never misses one, as a table of its words, looked up by a broadcast join. Columns of rows,
    texts among them, stay in the JVM and out of any buffer."""

    def __init__(self, keys: DataFrame, column: str):
        bit = keys.select(self._bit(F.col(column)).alias("b"))
        words = bit.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 AS INT))").alias("x"))
        self.words = spill(words.groupBy("w").agg(F.bit_or("x").alias("x")), "filter")

    @staticmethod
    def _bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """df's rows whose column may be among the keys, and those whose isn't."""
        w, x, b = no_clash(df, "_w", "_x", "_b")
        marked = df.withColumn(b, self._bit(F.col(column))).join(F.broadcast(self.words.toDF(w, x)), F.shiftright(b, 6) == F.col(w), "left")
        there = F.expr(f"coalesce(shiftrightunsigned(`{x}`, cast(`{b}` & 63 AS INT)) & 1 = 1, false)")
        return tuple(marked.where(there if inside else ~there).select(*(F.col(f"`{c}`") for c in df.columns)) for inside in (True, False))


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df's rows whose column may be among keys (a superset of a semi join; a join must follow): spares the shuffle most other rows."""
    return Filter(keys, column).split(df, column)[0]

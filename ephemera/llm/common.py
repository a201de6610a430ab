"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that count as white space in the operators' contracts: space and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Deletes a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether a written table gets the file _SUCCESS. Hadoop starts a process on the driver for it, which counts with the whole driver's memory for a moment.
MARKER = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_white(text: Column) -> Column:
    """Deletes every white-space character; literal replaces are several times faster than a regex or translate()."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value within an expression, so that a lambda does not compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements that one pass adds to an array, which is copied for each.
RUN = 256


def sums_before(sizes: Column) -> Column:
    """array<bigint>: for each element the sum of those before it. Runs of RUN are summed by themselves, so long arrays do not cost their square. Null gives no sums."""

    def run(values: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, none, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_runs(array: Column) -> Column:
        at = F.when(F.size(array) > 0, F.sequence(F.lit(0), F.floor((F.size(array) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.slice(array, k * RUN + 1, RUN))

    zero = F.lit(0).cast("bigint")
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    return let(F.transform(sizes, lambda x: x.cast("bigint")), lambda array: let(by_runs(array), lambda parts: F.flatten(F.zip_with(parts, run(F.transform(parts, total), zero), run))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has columns called so (in any case), for columns that an operator adds for a while."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder in spark.checkpoint.dir, so that a lost executor loses no work.

    The folder is read from the session. Where it is unset a temporary one is made in local mode; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        context = spark.sparkContext
        root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="spark-shared-")
            context.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, path: str, mode: str = "errorifexists", batch: int | None = None) -> None:
        """Writes df as Parquet; its shuffle files go at once. batch: rows in an Arrow batch meanwhile, for memory where rows hold whole texts."""
        conf = {CLEAN_UP: "true"} | ({ARROW_ROWS: str(batch)} if batch else {})
        was = {k: self.spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            df.write.mode(mode).option("compression", "zstd").option(MARKER, "false").parquet(path)
        finally:
            for k, v in was.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def save(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """Writes df below the folder and returns it as read back; see write()."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        self.write(df, path, batch=batch)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

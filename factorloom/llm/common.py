"""What the corpus operators share: tables in the cluster's shared folder, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship

ARROW_ROWS = 1000  # of a batch that a Python worker gets: texts may be long
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths that the innermost running operator wrote; each thread of the driver has its own.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def prepared(spark: SparkSession) -> None:
    """Sends the package to the workers, and bounds the session's Arrow batches by ARROW_ROWS rows."""
    ship(spark)
    now = int(spark.conf.get(_ARROW))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(_ARROW, ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its
    process; on a cluster, whose executors would not see that one, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='factorloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: freed at the end of a tidy operator, or of the driver's Python."""
    path = f"{shared_dir(spark)}/factorloom/{name}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    else:
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path; of a session that is stopped, only a local one can still be reached."""
    if spark.sparkContext._jsc is None:
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(operator):
    """The operator with its result written, and all other tables that it wrote freed when it ends."""

    @wraps(operator)
    def run(*args, **kwargs):
        paths: list[str] = []
        outer = _scope.set(paths)
        try:
            result = operator(*args, **kwargs)
        except BaseException:
            for path in paths:
                with suppress(Exception):  # the error itself tells more
                    remove(getattr(args[0], "sparkSession", args[0]), path)
            raise
        finally:
            _scope.reset(outer)
        try:
            return written(result, operator.__name__)
        finally:
            for path in paths:
                remove(result.sparkSession, path)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: its lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Frees a written table that no later step reads."""
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        remove(table.sparkSession, folder)


def at_most(table: DataFrame, count: str, n: int) -> DataFrame:
    """The rows of a written table whose count is 2^k or more, for the least k that leaves at most n rows.

    The driver gets a histogram of at most 64 rows; nothing is sorted."""
    level = F.floor(F.log2(F.col(count))).cast("int")
    sizes = dict(table.filter(F.col(count) > 0).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())
    least, left = 64, 0
    for k in range(63, -1, -1):
        left += sizes.get(k, 0)
        if left > n:
            break
        least = k
    return table.filter((F.col(count) > 0) & (level >= least))


BITS = 1 << 25  # of a bitmap of ids: 4 MB, however many ids there are


def id_bitmap(ids: DataFrame, name: str) -> DataFrame:
    """Bitmaps of the hashed ids of a column: at most BITS / 32768 rows of 4 KB each."""
    place = F.pmod(F.xxhash64(name), F.lit(BITS))
    return written(
        ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bits")),
        "bitmap",
    )


def perhaps_in(rows: DataFrame, name: str, bitmap: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose id is perhaps (or, not wanted, surely not) among those of the bitmap.

    The bitmap's size is bounded, so that it is broadcast and the rows are not shuffled. Where very
    many ids fill it, it lets all rows pass: what follows must still join on the id.
    """
    spot = F.expr(f"bitmap_bit_position(pmod(xxhash64({name}), {BITS}L))").cast("int")
    byte = F.conv(F.hex(F.expr("substring(_bits, _byte + 1, 1)")), 16, 10).cast("int")
    near = rows.withColumn("_bucket", F.expr(f"bitmap_bucket_number(pmod(xxhash64({name}), {BITS}L))")).join(F.broadcast(bitmap), "_bucket", "left")
    near = near.withColumn("_spot", spot).withColumn("_byte", F.floor(F.col("_spot") / 8).cast("int"))
    hit = F.col("_bits").isNotNull() & (F.expr("shiftright(_b, _spot % 8)").bitwiseAND(1) == 1)
    found = near.withColumn("_b", F.coalesce(byte, F.lit(0))).filter(hit if wanted else ~hit)
    return found.select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b): component is the least node reachable.

    Each level draws an order of the nodes by a hash; each node's parent is the first of itself and
    its neighbours in that order. Edges between parents are the next level's, until none is left: a
    level loses the last node of each component at least, and about half of a path or all of a star
    but two. Parents are then followed back. Nodes are longs; loops are ignored.
    """
    alive = written(_between(edges.select("a", "b")), "edges")
    levels: list[DataFrame] = []
    while not alive.isEmpty():
        level = F.lit(len(levels))
        place = lambda x: F.struct(F.xxhash64(x, level).alias("h"), F.col(x).alias("x"))  # noqa: B023, E731
        both = alive.unionByName(alive.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min(place("b")).alias("first")).select(
            F.col("a").alias("node"), F.least("first", place("a"))["x"].alias("parent")
        )
        # written tables: a join reads two plain exchanges, and a node with very many neighbours can be split
        levels.append(written(parents, "parents"))
        at = lambda x: levels[-1].select(F.col("node").alias(x), F.col("parent").alias(f"p{x}"))
        moved = alive.join(at("a"), "a").join(at("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        alive = written(_between(moved), "edges")
    if not levels:
        return alive.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rooted = levels.pop()
    for parents in reversed(levels):
        above = rooted.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        rooted = written(parents.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")), "rooted")
    least = written(rooted.groupBy("parent").agg(F.min("node").alias("component")), "least")
    return written(rooted.join(least, "parent").select("node", "component"), "components")


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, the lesser node first."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

"""What the corpus operators share: durable intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's spark.checkpoint.dir names it. Where none is named, one is made for a session that has no other
    machine than this; on a cluster there is then no place that all executors are known to see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veriscribe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def nested(docs: DataFrame) -> DataFrame:
    """(row, text) of every row, row with all its columns, so that no column made later can clash with them."""
    return docs.select(F.struct("*").alias("row"), F.col("text"))


def tidy(spark: SparkSession) -> bool:
    """Collect the driver's garbage and give what is free to the machine; whether its JVM did so too.

    Spark removes what was shuffled once the driver has collected its own references. Python and the JVM's compilers
    keep freed memory in the heaps of their C library, some hundred MB after many plans, unless those are trimmed.
    """
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    try:
        java, of = spark.sparkContext._gateway.new_array, jvm.java.lang.Class.forName
        types, given = java(jvm.java.lang.Class, 4), java(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = of(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(beans, given)
    except Py4JError:  # an older or another JVM
        return False
    return True


def materialise(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again, which cuts its lineage; what was shuffled on the way goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that materialise() made and nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column, modulus: int):
    """CRC-32 of the decimal text of an id, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % modulus


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (src, dst); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Each step groups with a
    map-side minimum and joins it back, so a hub's neighbours are never gathered in one task.
    """
    e = materialise(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small)
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(e)
        e = new
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""What the corpus operators share: words as columns, tables in the shared folder, stable names."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words that are made of digits, lower-case ASCII letters and all that is not ASCII.
NOT_ITEM_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters outside ASCII that lower() could change; without one, lower() touches A-Z only.
_OTHER_UPPER = r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() is the fast way where no other letter has a case to lose."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, between: str) -> Column:
    """The words of a text, in order; none for null or empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local one, if all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir: not set")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        paths = {f.rpartition("/")[0] for f in df.inputFiles()}
        for p in paths:
            if "/tables/" in p:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over, rather than at some later collection; the driver's free memory goes back to the system."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Hands back what the driver's JVM holds outside its heap and no longer uses: plans are compiled there, and malloc keeps the room
    of each thread's largest. Whether the JVM could do it: HotSpot on Linux, from 17.0.9 on; elsewhere nothing happens."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # The server's own class is not open to Py4J: its interface's method is.
        types, given = array(jvm.Class, 4), array(jvm.Object, 4)
        for k, c in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = jvm.Class.forName(c)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def named(keys: DataFrame, by: list[str], name: str = "name", buckets: int = 4096) -> DataFrame:
    """One integer for each row of keys, which must be distinct: its rank in the sorted bucket that its hash picks.

    The same set of keys gets the same names on any cluster, and no task sorts more than a bucket.
    """
    from pyspark.sql import Window

    at = F.pmod(F.xxhash64(*by), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by))
    return keys.withColumn("_bucket", at).withColumn(name, (rank.cast("long") - 1) * buckets + F.col("_bucket")).drop("_bucket")

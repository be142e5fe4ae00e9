"""What the operators of this subpackage share: tables, durable intermediates, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; the default of the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates: spark.checkpoint.dir. Where that is unset, a temporary one serves a local
    session, as in tests; a cluster's executors would each write to their own disk, so that is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which Spark deletes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")  # what was shuffled goes with the job, and not when the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sifted(df: DataFrame, column: str, ids: DataFrame, most: int = 27) -> DataFrame:
    """df with __among: false only where the column's value is none of ids (a frame of one long column). A bit is set
    for each id's hash, of 32 bits an id and 2 ** most in all, so that few others pass, and what is broadcast
    is bounded; an exact join decides about those that pass."""
    ids = ids.toDF("id")
    bits = 1 << min(most, max(15, (32 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    page = lambda c: F.shiftright(place(c), 15)
    pages = ids.select(page(F.col("id")).alias("__page"), F.pmod(place(F.col("id")), F.lit(1 << 15)).alias("at"))
    pages = pages.repartition("__page").groupBy("__page").agg(F.bitmap_construct_agg("at").alias("__set"))
    at = F.pmod(place(F.col(column)), F.lit(1 << 15)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(__set, __at div 8 + 1, 1)")), 16, 10).cast("int")
    among = F.coalesce(F.expr("(__byte >> (__at % 8)) & 1") == 1, F.lit(False))
    out = df.withColumns({"__page": page(F.col(column)), "__at": at}).join(F.broadcast(stored(pages, "pages")), "__page", "left")
    return out.withColumn("__byte", byte).select(*df.columns, among.alias("__among"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), two longs: (node, component), the component's smallest node.

    Alternates large-star and small-star steps until nothing changes. Every step is a pre-aggregated minimum,
    which is written, and a join with it: both sides of the join are then plain exchanges, of which Spark may
    deal a hub's edges to several tasks. Each step's edges are written to the shared folder. Nodes without
    edges to others are not returned.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    old = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "large")
        dropped(low)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        small = stored(small.where("a <> b").distinct(), "small")
        # the steps keep the components; when each node has one edge, to a node that has none, they are done
        state = small.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        for done in (low, large, edges):
            dropped(done)
        edges = small
        if state == old:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        old = state

"""What the operators need of the session."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names in spark.checkpoint.dir; in local mode Spark's own folder serves where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def settled(rows: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder.

    Rounds that build on each other need this in place of checkpoint(), which hands on the estimated size of the whole plan before it:
    joins multiply that, so that after a dozen rounds the number alone fills the driver.
    """
    spark = rows.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table._settled_at = path
    return table


def forget(*written: DataFrame) -> None:
    """Deletes the files of checkpoints and settled tables that nothing reads any more, since what was made of them is written itself.

    Also asks the driver for a collection, after which Spark removes the shuffle files of queries that are done.
    """
    for rows in written:
        context = rows.sparkSession.sparkContext
        at = getattr(rows, "_settled_at", None)
        if at is None:
            file = rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            at = file.get() if file.isDefined() else None
        if at is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if written:
        written[0].sparkSession.sparkContext._jvm.System.gc()


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """Column names that begin with the stems and clash with none of the taken ones, whatever their case."""
    used, out = {c.lower() for c in taken}, []
    for name in stems:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out

"""The store: a Parquet table keyed by URL in versions; an upsert writes a new version and then moves the pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ("pendiente", "postulada", "descartada")


def keep_state(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``nuevo`` tells URLs not stored yet; a stored state survives."""
    known = stored.select("url", F.col("estado").alias("_estado"), F.lit(True).alias("_known"))
    rows = incoming.drop("nuevo", "estado").join(known, "url", "left")
    return rows.withColumns({"nuevo": F.col("_known").isNull(), "estado": F.coalesce("_estado", F.lit("pendiente"))}).drop("_estado", "_known")


def last_of_each(rows: DataFrame, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("url").orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Incoming rows replace stored ones of the same URL. Where URLs come repeatedly, ``order`` tells the arrival; the last wins and the column goes."""
    if order is not None:
        incoming = last_of_each(incoming, order).drop(order)
    return incoming.unionByName(stored.join(incoming.select("url"), "url", "left_anti"))


def live(stored: DataFrame) -> DataFrame:
    return stored.where("estado != 'descartada'").orderBy(F.desc("matchScore"), "url")


def set_state(stored: DataFrame, url: str, state: str) -> DataFrame:
    if state not in STATES:
        raise ValueError(f"unknown state {state}")
    return stored.withColumn("estado", F.when(F.col("url") == url, state).otherwise(F.col("estado")))


def apply_or_undo(stored: DataFrame, url: str) -> DataFrame:
    """A posting applied to is pending again; any other counts as applied to."""
    toggled = F.when(F.col("estado") == "postulada", "pendiente").otherwise("postulada")
    return stored.withColumn("estado", F.when(F.col("url") == url, toggled).otherwise(F.col("estado")))


def discard(stored: DataFrame, url: str) -> DataFrame:
    return set_state(stored, url, "descartada")


def restore_discarded(stored: DataFrame) -> DataFrame:
    return stored.withColumn("estado", F.when(F.col("estado") == "descartada", "pendiente").otherwise(F.col("estado")))


def purge(stored: DataFrame, as_of_ms: int, days: int = 30, legacy: bool = False) -> DataFrame:
    """Without postings older than ``days``, but for those applied to. ``legacy`` compares with seconds, which removes none."""
    limit = as_of_ms - days * 86_400_000
    limit = limit // 1000 if legacy else limit
    return stored.where(~((F.col("fechaEpoch") > 0) & (F.col("fechaEpoch") < limit) & (F.col("estado") != "postulada")))


def urls(stored: DataFrame) -> DataFrame:
    return stored.select("url")


def states(stored: DataFrame) -> DataFrame:
    return stored.where("estado != 'pendiente'").select("url", "estado")


def descriptions(stored: DataFrame, least_chars: int = 400) -> DataFrame:
    return stored.where(F.length("descripcion") >= least_chars).select("url", "descripcion")


class Store:
    """Versions of the table under one folder; readers see the version that the pointer names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pointer")

    def version(self) -> int:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return -1
        return self._pointer().agg(F.max("version")).first()[0]

    def read(self) -> DataFrame | None:
        version = self.version()
        return None if version < 0 else self.spark.read.parquet(f"{self.folder}/v{version}")

    def write(self, rows: DataFrame) -> None:
        """A failed write leaves the old version in place."""
        version = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.folder}/pointer")

    def clear(self) -> None:
        """Deletes all rows: a new version without any."""
        stored = self.read()
        if stored is not None:
            self.write(stored.limit(0))

    def count(self) -> int:
        stored = self.read()
        return 0 if stored is None else stored.count()

    def merge(self, incoming: DataFrame, stored: DataFrame | None = None) -> None:
        """Upserts into the stored rows, or into what is left of them in ``stored``."""
        stored = self.read() if stored is None else stored
        if stored is None:
            self.write(incoming.drop("nuevo", "estado").withColumns({"nuevo": F.lit(True), "estado": F.lit("pendiente")}))
        else:
            self.write(upsert(stored, keep_state(incoming, stored).select(*stored.columns)))

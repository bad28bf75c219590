"""Checksums, run manifests, restart-safe recomputation, sealed runs, scratch space."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_base: dict[str, str] = {}


def _default_base(spark: SparkSession) -> str:
    """A folder of this application under the default filesystem, removed when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _own_base:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"/tmp/{sc.applicationId}-{uuid.uuid4().hex}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        path = fs.makeQualified(path)
        refuse_local(path.toString(), sc.master)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _own_base[sc.applicationId] = path.toString()
    return _own_base[sc.applicationId]


def refuse_local(path: str, master: str) -> None:
    """Driver and executors of a cluster do not share a local disk; only a local master may use one."""
    if path.startswith("file:") and not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {path} is on one machine")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, or where that is unset under the default filesystem."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _default_base(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the session's folder when it names one, else a scratch folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))


def checksums(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, level: int = -1) -> DataFrame:
    """(file, bytes, sha256) of every file, named by the path's element ``level`` (-1: the file itself, -2: its folder).

    Files over 2 GiB make the binary source fail loudly.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(
        F.element_at(F.split("path", "/"), level).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def content_checksums(artifacts: DataFrame) -> DataFrame:
    """(file, bytes, sha256) of artifacts that are rows (file, content)."""
    return artifacts.select("file", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registry entries with OK / MISSING / HASH_MISMATCH."""
    f = files.select("file", F.col("sha256").alias("__actual"))
    j = registry.select("file", "sha256").join(f, "file", "left")
    status = (
        F.when(F.col("__actual").isNull(), "MISSING").when(F.col("__actual") != F.col("sha256"), "HASH_MISMATCH").otherwise("OK")
    )
    return j.select("file", status.alias("status"))


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append (unit, status, rows, path, reasons) to the run manifest."""
    rows.write.mode("append").parquet(path)


def missing_units(expected: DataFrame, manifest: DataFrame, unit: Sequence[str], fingerprint: Sequence[str] = ()) -> DataFrame:
    """Units without a PASS row (for the same input fingerprint): the ones a restart has to compute."""
    done = manifest.where("status = 'PASS'").select(*unit, *fingerprint).distinct()
    return expected.join(done, [*unit, *fingerprint], "left_anti")


def latest_run(files: DataFrame, required: Sequence[str], run: str = "run_id", name: str = "file") -> DataFrame:
    """Newest run that holds every required file."""
    full = files.groupBy(run).agg(*[F.bool_or(F.col(name) == r).alias(f"has_{i}") for i, r in enumerate(required)])
    ok = F.lit(True)
    for i in range(len(required)):
        ok = ok & F.col(f"has_{i}")
    return full.where(ok).agg(F.max(run).alias(run))


class AlreadyOpenedError(RuntimeError):
    pass


def seal(spark: SparkSession, path: str, note: str) -> None:
    """One-shot guard: the first call writes the marker, any later one fails."""
    try:
        spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("errorifexists").json(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise AlreadyOpenedError(path) from e
        raise

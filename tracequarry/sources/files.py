"""Files of any file system that Spark knows: listing, single files as output, copies, and the folder that the cluster shares."""

from __future__ import annotations

import fnmatch
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark names the folder of a null or empty partition value, and what a file of an empty name is called.
NO_NAME, EMPTY = "__HIVE_DEFAULT_PARTITION__", "%"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; below a temporary one where none is set, but only in a local session."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tracequarry")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder, so that no later part of a plan makes them again."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def list_files(spark: SparkSession, path: str, ending: str = "", deep: bool = False) -> list[str]:
    """The paths of a folder's files with an ending, sorted by name; of a file, its own. Hidden files don't count."""
    system, folder = _at(spark, path)
    if not system.exists(folder):
        raise FileNotFoundError(path)
    if system.getFileStatus(folder).isFile():
        return [path] if path.endswith(ending) else []
    found = system.listFiles(folder, deep)
    out = []
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().endswith(ending) and file.getName()[0] not in "._":
            out.append(file.toString())
    return sorted(out)


def write_single(rows: DataFrame, path: str, kind: str = "csv", **options) -> None:
    """One file with the rows, which must be few: a feature table has one row per log."""
    spark, parts = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    rows.coalesce(1).write.options(**options).format(kind).save(parts)
    (part,) = [f for f in list_files(spark, parts) if f.rsplit("/", 1)[-1].startswith("part-")]
    _move(spark, part, path)
    _delete(spark, parts)


def write_named(rows: DataFrame, folder: str, ending: str, order: list[str]) -> None:
    """A text file ``<name><ending>`` for each name in rows (name, value, order columns), its lines in order.

    A file is written by one task, streaming; files are written side by side, then moved to their names.
    Characters that a path can't hold are written as %XX, an empty name as %.
    """
    spark, parts = rows.sparkSession, f"{folder}/.parts-{uuid.uuid4().hex}"
    rows.repartition("name").sortWithinPartitions("name", *order).select("name", "value").write.partitionBy("name").text(parts)
    for file in list_files(spark, parts, ".txt", deep=True):
        name = file.rsplit("/", 2)[-2].removeprefix("name=")
        _move(spark, file, f"{folder}/{EMPTY if name == NO_NAME else name}{ending}")
    _delete(spark, parts)


def file_title(ending: str):
    """A file's name without its ending, as a column; what write_named() made of a name is undone."""
    decoded = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    name = F.regexp_replace(decoded(F.col("_metadata.file_name")), f"{ending.replace('.', '[.]')}$", "")
    return F.when(name == EMPTY, "").otherwise(decoded(name))


def copy_matching(spark: SparkSession, patterns: list[str], source: str, destination: str) -> int:
    """Copies the first file below ``source`` that each pattern matches to ``destination``, named ``<its folder>_<its name>``; how many files are there then.

    What matches nothing is reported by a warning.
    """
    files = list_files(spark, source, deep=True)
    for pattern in patterns:
        hits = [f for f in files if fnmatch.fnmatch(f.rsplit("/", 1)[-1], pattern) or fnmatch.fnmatch(f, f"*/{pattern}")]
        if not hits:
            warnings.warn(f"no file matches {pattern} in {source}", stacklevel=2)
            continue
        (system, path), (target_system, target) = _at(spark, hits[0]), _at(spark, f"{destination}/{'_'.join(hits[0].rsplit('/', 2)[-2:])}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, path, target_system, target, False, True, spark._jsc.hadoopConfiguration())
    return len(list_files(spark, destination))


def _move(spark: SparkSession, source: str, target: str) -> None:
    system, path = _at(spark, target)
    system.mkdirs(path.getParent())
    system.delete(path, False)
    if not system.rename(_at(spark, source)[1], path):
        raise OSError(f"{source} could not be moved to {target}")


def _delete(spark: SparkSession, folder: str) -> None:
    system, path = _at(spark, folder)
    system.delete(path, True)

"""Reading file trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.functions import paths as px
from scriptorium.session import cut_lineage


def scan_files(
    spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None, lenient: bool = False
) -> DataFrame:
    """All files under ``root`` as ``path, length, modificationTime, content``.

    The path is relative to ``root``.  Leave ``content`` out of the selection and
    Spark lists the files without opening them; filters on ``length`` reach the scan.
    ``glob`` keeps matching names before anything is read, for example ``{*.c,*.h}``.
    A ``lenient`` scan goes on past files that cannot be read; see :func:`unreadable`.
    What ``max_bytes`` leaves out is returned by :func:`too_large`.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if lenient:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    files = reader.load(root)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.withColumn("path", relative_to(F.col("path"), root))


def too_large(spark: SparkSession, root: str, max_bytes: int, glob: str | None = None) -> DataFrame:
    """``path, length, error`` for each file that a scan with the same ``max_bytes`` leaves out; none is opened."""
    files = scan_files(spark, root, glob).select("path", "length")
    return files.filter(F.col("length") > max_bytes).withColumn("error", F.lit("too large"))


def unreadable(listing: DataFrame, read: DataFrame) -> DataFrame:
    """``path, error`` for each file of a stored ``listing`` that a lenient scan did not ``read``."""
    missing = listing.select("path").join(read.select("path"), "path", "left_anti")
    return missing.withColumn("error", F.lit("cannot be read"))


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return F.substring(path, F.instr(path, base) + len(base), F.length(path))


def catalog(files: DataFrame) -> DataFrame:
    """``path, filename, parent, extension`` of each file, safe to store."""
    clean = files.select(px.sanitise(F.col("path")).alias("path"))
    return clean.select(
        "path",
        px.basename(F.col("path")).alias("filename"),
        px.parent(F.col("path")).alias("parent"),
        px.extension(F.col("path")).alias("extension"),
    )


def with_suffixes(files: DataFrame, suffixes: tuple[str, ...], names: tuple[str, ...] = ()) -> DataFrame:
    return files.filter(px.has_suffix(F.col("path"), suffixes, names))


def new_files(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned paths that are not known yet, once each."""
    return scanned.dropDuplicates(["path"]).join(known.select("path"), "path", "left_anti")


def path_id(path: Column, attempt: int = 0) -> Column:
    """The 64-bit id a path asks for: the first half of its MD5; a later attempt hashes the path with the attempt behind it."""
    text = path if attempt == 0 else F.concat(path, F.lit(f"\0{attempt}"))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def with_ids(fresh: DataFrame, known: DataFrame, wish: Callable[[Column, int], Column] = path_id) -> DataFrame:
    """``fresh`` (new paths, once each) with ``file_id``; ids in ``known`` (``file_id, path``) are taken.

    An id follows from the path alone, so it is the same in every run and needs no counter and no global order.  Where two paths
    ask for one id, the smaller one gets it unless it is taken, and the others ask again: a round for each collision in a row.
    """
    taken = known.select("file_id")
    rest, attempt, given = fresh.select("path"), 0, None
    while True:
        asked = cut_lineage(rest.withColumn("file_id", wish(F.col("path"), attempt)))
        won = (
            asked.groupBy("file_id").agg(F.min("path").alias("path"))
            .join(taken.withColumnRenamed("file_id", "taken_id"), F.col("file_id") == F.col("taken_id"), "left_anti")
        )
        won = cut_lineage(won.select("path", "file_id"))
        given = won if given is None else given.unionByName(won)
        rest = asked.select("path").join(won.select("path"), "path", "left_anti")
        if rest.isEmpty():
            return fresh.join(given, "path")
        taken, attempt = taken.unionByName(won.select("file_id")), attempt + 1


def collisions(files: DataFrame, wish: Callable[[Column, int], Column] = path_id) -> DataFrame:
    """``path, file_id`` of the files whose id is not the one their path asks for first: any other id follows from its path."""
    return files.filter(F.col("file_id") != wish(F.col("path"), 0)).select("path", "file_id")


def ids_of(paths: DataFrame, collided: DataFrame, wish: Callable[[Column, int], Column] = path_id) -> DataFrame:
    """``paths`` with the ids of indexed files, without reading the index: only the small table of collisions is joined."""
    moved = collided.select("path", F.col("file_id").alias("moved_id"))
    return paths.join(moved, "path", "left").withColumn("file_id", F.coalesce("moved_id", wish(F.col("path"), 0))).drop("moved_id")

"""Directory trees and path resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import paths as px


def directories(files: DataFrame) -> DataFrame:
    """Distinct folders on the way to each file."""
    return (
        files.select(F.explode(px.prefixes(px.parent(F.col("path")))).alias("dir")).filter("dir <> ''").distinct()
    )


def include_exclude(dirs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Folders outside every excluded subtree.

    A folder is dropped when one of its own prefixes is excluded, which is an equi-join
    on the few prefixes of each folder rather than a comparison of all pairs.
    """
    inside = (
        dirs.select("dir", F.explode(px.prefixes(F.col("dir"))).alias("prefix"))
        .join(excluded.select(F.col("dir").alias("prefix")), "prefix", "left_semi")
        .select("dir")
    )
    return dirs.select("dir").subtract(inside)


def path_tree(paths: DataFrame) -> DataFrame:
    """Every prefix of every path as ``path, parent, name, type``."""
    parts = paths.filter("path <> ''").select(F.posexplode(px.prefixes(F.col("path"))).alias("pos", "node"), F.size(
        F.split("path", "/")).alias("depth"))
    return (
        parts.groupBy(F.col("node").alias("path"))
        # "dir" sorts first: a node with anything below it is a folder.
        .agg(F.min(F.when(F.col("pos") + 1 == F.col("depth"), "file").otherwise("dir")).alias("type"))
        .select(
            "path", px.parent(F.col("path")).alias("parent"), px.basename(F.col("path")).alias("name"), "type"
        )
    )


def dir_listing(tree: DataFrame) -> DataFrame:
    """Children of every folder: folders first, then by lower-cased name.

    The order includes the name, so range partitioning can split one huge folder.
    """
    return tree.select("parent", "name", "path", "type").orderBy(
        "parent", F.col("type") == "file", F.lower("name"), "name"
    )


#: Tasks that the files of one name are spread over.
NAME_SALTS = 32


def _asked_endings(requests: DataFrame, anchored: bool) -> DataFrame:
    """``request, ending, name`` of every distinct request."""
    clean = px.forward_slashes(F.col("request"))
    return (
        requests.select("request").distinct()
        .withColumn("ending", F.regexp_replace(clean, "^/", "") if anchored else clean)
        .withColumn("name", px.basename(F.col("ending")))
    )


def endings(files: DataFrame, wanted: DataFrame, anchored: bool = True) -> DataFrame:
    """``file_id, path, rank, key`` of stored paths: the path itself (rank 0) and its endings (rank 1), of asked lengths only.

    ``wanted``: ``request, ending, name``.  For each asked name the lengths of what is asked for it are known; a path with that name is cut
    at just these, so a path nobody asks for gives nothing and a long one no more than is asked.  The files of one name
    are spread over ``NAME_SALTS`` tasks.
    """
    asked = wanted.groupBy(F.col("name").alias("asked_name")).agg(
        F.collect_set(F.length("request")).alias("wholes"), F.collect_set(F.length("ending")).alias("lengths")
    ).withColumn("asked_salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
    slashed = files.select("file_id", "path", px.forward_slashes(F.col("path")).alias("slashed"))
    stored = slashed.withColumn("name", px.basename(F.col("slashed"))).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(NAME_SALTS)).cast("int"))
    near = stored.join(asked, (F.col("name") == F.col("asked_name")) & (F.col("salt") == F.col("asked_salt")))
    size = F.length("slashed")
    fits = F.filter("lengths", lambda n: (n < size) & (F.substring(F.col("slashed"), size - n, F.lit(1)) == "/") if anchored else n < size)
    cut = F.transform(F.array_union(fits, F.filter("lengths", lambda n: n == size)), lambda n: F.substring(F.col("slashed"), size - n + 1, n))
    whole = F.filter(F.array("path"), lambda p: F.array_contains("wholes", F.length(p)))
    keys = F.concat(
        F.transform(whole, lambda k: F.struct(F.lit(0).alias("rank"), k.alias("key"))),
        F.transform(cut, lambda k: F.struct(F.lit(1).alias("rank"), k.alias("key"))),
    )
    return near.select("file_id", "path", F.explode(keys).alias("k")).select("file_id", "path", "k.rank", "k.key")


def resolve_path(requests: DataFrame, files: DataFrame, anchored: bool = True) -> DataFrame:
    """Stored file of each ``request``: the same path, else the lowest id whose path ends with it.

    With ``anchored`` the match starts at a path component; without it any ending
    that holds the whole file name counts.

    Stored paths are cut at the asked lengths and reduced to the lowest id per ending before the join.  A name shared by a
    third of the files is thus folded on the map side, and each request meets one row: no pairs within a name are ever built.
    """
    wanted = _asked_endings(requests, anchored)
    targets = (
        endings(files, wanted, anchored)
        .groupBy("rank", "key")
        .agg(F.min(F.struct("file_id", "path")).alias("file"))
    )
    asked = wanted.select(
        "request",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("rank"), F.col("request").alias("key")),
                F.struct(F.lit(1).alias("rank"), F.col("ending").alias("key")),
            )
        ).alias("k"),
    ).select("request", "k.rank", "k.key")
    hits = (
        asked.join(targets, ["rank", "key"])
        .groupBy("request")
        .agg(F.min(F.struct("rank", "file.file_id", "file.path")).alias("hit"))
    )
    return requests.join(hits, "request", "left").select(
        *requests.columns, F.col("hit.file_id").alias("file_id"), F.col("hit.path").alias("path")
    )


def resolve_prefix(requests: DataFrame, files: DataFrame, prefix: str = "source-code/") -> DataFrame:
    """Stored file of each ``request`` as given, else below ``prefix``."""
    asked = requests.select("request").distinct()
    tries = asked.select(
        "request",
        F.posexplode(F.array(F.col("request"), F.concat(F.lit(prefix), F.col("request")))).alias("rank", "path"),
    )
    hits = (
        tries.join(files.select("file_id", "path"), "path")
        .groupBy("request")
        .agg(F.min(F.struct("rank", "file_id", "path")).alias("hit"))
    )
    return requests.join(hits, "request", "left").select(
        *requests.columns, F.col("hit.file_id").alias("file_id"), F.col("hit.path").alias("path")
    )

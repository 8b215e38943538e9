"""Streams, checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.plans import fixtures as fx
from scriptorium.plans.annotations import _LATEST
from scriptorium.plans.dialect import FILENAME
from scriptorium.plans.register import Register
from scriptorium.session import working_dir
from scriptorium.sources import catalog as ct
from scriptorium.sources.tables import ANNOTATIONS
from scriptorium.streaming import increments as inc

query = Register()

#: Files of one listing.
LISTING_FILES = 8


@query(fx.with_views(f"SELECT DISTINCT path, {FILENAME} AS filename FROM tree_files", "tree_files"))
def arrivals_stream(spark: SparkSession, d: str) -> DataFrame:
    base = working_dir(spark, "arrivals")
    listing = ct.catalog(fx.tree_files(spark, d)).select("path", "filename")
    # Overlapping listings: the source files, the archives, then everything once more.  Each comes in so many files however large it is,
    # not in one for each split of the long texts it is read beside, so batches grow with the listing and not in number.
    for part in (listing.filter("path NOT LIKE '%,v'"), listing.filter("path LIKE '%,v'"), listing):
        part.repartition(LISTING_FILES).write.mode("append").parquet(f"{base}/in")
    arrivals = spark.readStream.schema(inc.ARRIVALS).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    inc.index_arrivals(arrivals, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return inc.indexed(spark, f"{base}/out")


@query(fx.with_views(_LATEST, "annotations"))
def annotation_stream(spark: SparkSession, d: str) -> DataFrame:
    base = working_dir(spark, "log")
    # Four files that are out of order among each other.
    fx.annotations(spark, d).repartition(4, F.col("id") % 7).write.parquet(f"{base}/in")
    log = spark.readStream.schema(ANNOTATIONS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    inc.follow_annotations(log, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return inc.followed(spark, f"{base}/out")

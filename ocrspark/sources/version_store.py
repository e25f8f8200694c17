"""Versions of the same documents stored by page, so that comparing two of them moves no words.

All versions lie in one table with a folder per version, hashed by page into the same number of buckets.
Words of one page are then in the bucket of the same number in every version, and Spark joins,
groups and ranks by page, or by page and more, without a shuffle. A bucket is read by one task, so
pages with very many words are kept out of the buckets and take the shuffled way.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ocrspark import pins
from ocrspark.session import by_parts, small_side, stack, stored

PAGE = list(pins.PAGE_KEY)
#: Words of a page above which it is kept out of the buckets, and words a bucket should hold.
LARGE_PAGE = 200_000
BUCKET_WORDS = 500_000
#: Bounds of the number of buckets; the upper one is Spark's own.
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
_COMMITS = "version string, generation string, at bigint"


@dataclass(frozen=True)
class VersionStore:
    """Below ``path`` lie the buckets, known to Spark as ``table``, and the words of large pages.

    Every call of :func:`store_version` writes a generation of rows, and a row of ``commits`` makes it
    the present one of its version when all is written; readers never see half a version.
    """

    spark: SparkSession
    path: str
    table: str
    buckets: int

    def versions(self) -> list[str]:
        """Labels of the stored versions."""
        return sorted(r.version for r in self._commits().select("version").distinct().collect())

    def words(self, version: str) -> DataFrame:
        """All words of a version."""
        generation = self._generation(version)
        return stack(self._bucketed(generation), self._large("large_words", generation)).drop("generation")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")

    def _generation(self, version: str) -> str:
        own = self._commits().filter(F.col("version") == version)
        found = own.agg(F.max_by("generation", "at").alias("generation")).first().generation
        if found is None:
            raise ValueError(f"no version {version!r} in {self.path}")
        return found

    def _bucketed(self, generation: str) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("generation") == generation)

    def _large(self, folder: str, *generations: str) -> DataFrame:
        rows = self.spark.table(self.table)
        schema = rows.schema if folder == "large_words" else rows.select(*PAGE, "generation").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").filter(F.col("generation").isin(*generations))


def create(words: DataFrame, path: str, buckets: int | None = None) -> VersionStore:
    """An empty store below ``path`` for versions with the columns of ``words``.

    The number of buckets follows from the count of ``words`` unless it is given; it holds for all versions.
    """
    spark = words.sparkSession
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-words.count() // BUCKET_WORDS)))
    about = spark.createDataFrame([(buckets, words.schema.json())], "buckets int, words string")
    about.coalesce(1).write.parquet(f"{path}/about")
    empty = words.limit(0).withColumn("generation", F.lit(""))
    empty.write.partitionBy("generation").parquet(f"{path}/large_words")
    empty.select(*PAGE, "generation").write.partitionBy("generation").parquet(f"{path}/large_pages")
    spark.createDataFrame([], _COMMITS).write.parquet(f"{path}/commits")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> VersionStore:
    """The store that was made below ``path``, also by another application."""
    about = spark.read.parquet(f"{path}/about").first()
    fields = StructType.fromJson(json.loads(about.words)).fields
    table = "page_versions_" + hashlib.sha256(path.encode()).hexdigest()[:12]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"create table if not exists {table} ({columns}, generation string) using parquet"
        f" partitioned by (generation) clustered by ({', '.join(PAGE)}) into {about.buckets} buckets"
        f" location '{path}/buckets'"
    )
    return VersionStore(spark, path, table, about.buckets)


def store_version(
    store: VersionStore, words: DataFrame, version: str, large: int = LARGE_PAGE, dealt: DataFrame | None = None
) -> None:
    """Write ``words`` as ``version``, in place of what was stored under that label.

    ``words`` is read twice: its words are counted by page, then dealt to the buckets by one shuffle,
    the last that they need. Pages of more than ``large`` words go to files of their own. A call
    that fails leaves the former words in force.

    ``dealt`` are the same words where they come from rows that were dealt by ``repartition(store.buckets, *PAGE)``,
    such as the texts that they are cut out of: they are written as they come and no word is shuffled. ``words``
    are then counted only. Words dealt in another way must not be given so: the buckets would be many small files.
    """
    spark = store.spark
    generation = f"g{uuid.uuid4().hex[:16]}"
    label = F.lit(generation).alias("generation")
    names = spark.table(store.table).columns[:-1]
    many = words.groupBy(*PAGE).count().filter(F.col("count") > large).select(*PAGE)
    pages = small_side(many, "large-pages")
    if dealt is None:
        ordinary = words.join(pages, PAGE, "left_anti").repartition(store.buckets, *PAGE)
    else:
        ordinary = dealt.join(pages, PAGE, "left_anti")
    ordinary.select(*names, label).write.insertInto(store.table)
    apart = words.join(pages, PAGE, "left_semi").select(*names, label)
    for folder, rows in (("large_words", apart), ("large_pages", pages.select(*PAGE, label))):
        rows.write.mode("append").partitionBy("generation").parquet(f"{store.path}/{folder}")
    done = spark.createDataFrame([(version, generation, time.time_ns())], _COMMITS)
    done.coalesce(1).write.mode("append").parquet(f"{store.path}/commits")


@contextmanager
def by_page(spark: SparkSession):
    """Plans made inside take rows hashed by page for hashed by page and more.

    Spark otherwise shuffles both sides of a join whose keys are more than those of the buckets, to
    be safe from skew. Here pages are bounded, as the large ones are not in the buckets. Afterwards the
    application's own setting holds.
    """
    try:
        yield by_parts(spark)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def compared(store: VersionStore, a: str, b: str, operator: Callable[..., DataFrame], **options) -> list[DataFrame]:
    """``operator(words of a, words of b, page_levels=...)`` over the buckets and over the large pages.

    The first result reads all pages that are large in neither version, to be planned inside :func:`by_page`;
    the second, where there is one, reads those that are large in any, by way of a shuffle.
    """
    first, second = store._generation(a), store._generation(b)
    sides = [store._bucketed(g).drop("generation") for g in (first, second)]
    large = store._large("large_pages", first, second).select(*PAGE).distinct()
    if large.isEmpty():
        return [operator(*sides, page_levels=True, **options)]
    pages = small_side(large, "large-pages")
    ordinary = [words.join(pages, PAGE, "left_anti") for words in sides]
    apart = [store.words(v).join(pages, PAGE, "left_semi") for v in (a, b)]
    return [operator(*ordinary, page_levels=True, **options), operator(*apart, **options)]


def compare(store: VersionStore, a: str, b: str, operator: Callable[..., DataFrame], **options) -> DataFrame:
    """Rows of ``operator``, an operator over two versions, for the stored versions ``a`` and ``b``.

    The operator must treat every page alone, as those of ``operators.evaluate`` do. Runs the
    comparison when it is called and returns its written result.
    """
    with by_page(store.spark):
        results = compared(store, a, b, operator, **options)
        written = [stored(df, "compared") for df in results]
    return stack(*written)

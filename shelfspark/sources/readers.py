"""Reading listings, pages and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.numbers import to_number
from shelfspark.functions.times import to_time
from shelfspark.operators.filters import by_keyword, by_source, positive_price, with_created_at
from shelfspark.operators.quality import clean_frame
from shelfspark.schemas import ANALYSIS_COLUMNS, LISTING

_CORRUPT = "_corrupt_record"


_AS_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in LISTING.fields])


def _typed(value: Column, kind: T.DataType) -> Column:
    """A value read as text in its declared type; what does not fit becomes null, and only that."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.from_json(value, kind)
    if isinstance(kind, T.DoubleType):
        return to_number(value)
    if isinstance(kind, T.IntegerType):
        return to_number(value).try_cast("int")
    if isinstance(kind, T.BooleanType):
        return value.try_cast("boolean")
    return to_time(value) if isinstance(kind, T.TimestampNTZType) else value


def _documents(spark: SparkSession, path: str, recursive: bool, multiline: bool) -> DataFrame:
    """Every document with all its fields as text; text that is no JSON stands in its own column."""
    whole = T.StructType(
        [*_AS_TEXT.fields, T.StructField("products", T.StringType()), T.StructField(_CORRUPT, T.StringType())]
    )
    return (
        spark.read.schema(whole)
        .option("multiLine", multiline)
        .option("recursiveFileLookup", recursive)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )


def read_listing_files(spark: SparkSession, path: str, recursive: bool = True, multiline: bool = True) -> DataFrame:
    """Listings out of JSON: an object with a products array, or a root array of listings.

    Fields are read as text and coerced one by one, so an odd value costs only itself. Documents that are no JSON are
    skipped; :func:`broken_documents` lists them. ``multiline=False`` reads one document per line, which splits large files.
    """
    raw = _documents(spark, path, recursive, multiline).where(F.col(_CORRUPT).isNull())
    # A row without a products array is one element of a root array; files of other kinds have none of the fields.
    anything = F.coalesce(*_AS_TEXT.fieldNames()).isNotNull()
    single = F.when(F.col("products").isNull() & anything, F.array(F.struct(*_AS_TEXT.fieldNames())))
    listed = F.transform(F.from_json("products", T.ArrayType(T.StringType())), lambda p: F.from_json(p, _AS_TEXT))
    rows = raw.select(F.explode(F.coalesce(listed, single)).alias("_row")).where(F.col("_row").isNotNull())
    return rows.select(*[_typed(F.col(f"_row.{f.name}"), f.dataType).alias(f.name) for f in LISTING.fields])


def broken_documents(spark: SparkSession, path: str, recursive: bool = True, multiline: bool = True) -> DataFrame:
    """(file, document) of what :func:`read_listing_files` skips because it is no JSON."""
    raw = _documents(spark, path, recursive, multiline)
    # Spark wants a column of the schema besides the text of the broken document.
    seen = F.length(F.concat_ws("", F.col(_CORRUPT), F.col("products"))) >= 0
    broken = raw.where(F.col(_CORRUPT).isNotNull() & seen)
    return broken.select(F.col("_metadata.file_path").alias("file"), F.col(_CORRUPT).alias("document"))


def read_listings(
    spark: SparkSession, path: str, fmt: str = "parquet", recursive: bool = True, **options: str
) -> DataFrame:
    """Listings from Parquet, JSON files or a JDBC table (``path`` is the table name, ``options`` the connection)."""
    if fmt == "json":
        return read_listing_files(spark, path, recursive, options.get("multiline", True))
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    return spark.read.parquet(path)


def analysis_scan(df: DataFrame, newest_first: bool = True) -> DataFrame:
    """The columns the analyses use, positive prices only, with the created_at alias."""
    columns = [c for c in ANALYSIS_COLUMNS if c in df.columns]
    rows = with_created_at(positive_price(df).select(*columns))
    return rows.orderBy(F.desc("scraped_at")) if newest_first else rows


def load_listings(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Listings ready for analysis: stored tables as a scan, files cleaned and without repeated titles.

    Among files the earliest sighting of a title counts, then the smallest address and price.
    """
    rows = read_listings(spark, path, fmt, **options)
    if fmt != "json":
        return analysis_scan(rows, newest_first=False)
    return with_created_at(clean_frame(rows, ["scraped_at", "url", "price"]))


def find_listings(
    df: DataFrame,
    source: str | None = None,
    keyword: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    order_by: str = "scraped_at",
    desc: bool = True,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Filtered, ordered page of listings; an unknown order column is ignored."""
    rows = df
    if source:
        rows = by_source(rows, source)
    if keyword:
        rows = by_keyword(rows, keyword)
    if order_by in df.columns:
        first = F.desc_nulls_last(order_by) if desc else F.asc_nulls_first(order_by)
        rows = rows.orderBy(first, *tiebreak)
    if offset > 0:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit else rows


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count) for every table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan over all cores when the scan itself yields fewer tasks; parsing costs more than moving."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows that become long work, over several tasks a core, however the scan cuts them.

    Splits of a scan tell nothing of their rows, as a file of few row groups leaves most of them empty; and while executors
    still register, few cores are known.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, key)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as (page_id, url, html)."""
    return spread(spark.read.parquet(path).select("page_id", "url", "html"), "page_id")

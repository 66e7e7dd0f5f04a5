"""Paged JSON records: landed page files, or a fetcher that is called once per page on the executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowmetrics.functions.variants import ddl, plain_type
from flowmetrics.session import settle

# fetcher(offset, limit) -> parsed JSON of one page: a list, an object, or an object around ``records_key``
Fetcher = Callable[[int, int | None], object]


def page_records(page: object, records_key: str | None) -> list:
    records = page[records_key] if records_key else page
    return records if isinstance(records, list) else [records]


class Pages(InputPartition):
    """Pages at ``offset``, ``offset + step``, … up to the first short one; a single page without ``step``."""

    def __init__(self, offset: int, step: int | None):
        super().__init__(offset)
        self.offset, self.step = offset, step


class PagedRecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch: Fetcher = cloudpickle.loads(bytes.fromhex(options["fetcher"]))
        self.records_key = options.get("records_key")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.readers = int(options["readers"])
        self.fetch_all = options.get("fetch_all", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        if not self.fetch_all or self.limit is None:
            return [Pages(0, None)]
        return [Pages(k * self.limit, self.readers * self.limit) for k in range(self.readers)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        offset = partition.offset
        while True:
            try:
                records = page_records(self.fetch(offset, self.limit), self.records_key)
            except Exception as problem:  # noqa: BLE001 - reported as a row, see load errors
                yield None, offset, f"{type(problem).__name__}: {problem}", None
                return
            for record in records:
                yield json.dumps(record), offset, None, None
            yield None, offset, None, len(records)
            if partition.step is None or len(records) < self.limit:
                return
            offset += partition.step


class PagedRecords(DataSource):
    """Rows ``(registro, offset, error, n_pagina)``: a record as JSON text, the error of a page, or a page's size."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "registro string, offset bigint, error string, n_pagina int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedRecordsReader(dict(self.options))


def fetch_pages(
    spark: SparkSession,
    fetcher: Fetcher,
    records_key: str | None = None,
    limit: int | None = None,
    fetch_all: bool = False,
    total: int | None = None,
    readers: int | None = None,
) -> DataFrame:
    """Raw pages of a fetcher as ``(registro, offset, error, n_pagina)``.

    ``readers`` tasks (by default the session's parallelism) share the offsets in turns, each up to its own first short
    page, so the end needs no known total and no page is left out. ``total`` only tells how many tasks are worth it.
    """
    import sys

    readers = readers or spark.sparkContext.defaultParallelism
    if total is not None and limit:
        readers = min(readers, -(-total // limit))
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(PagedRecords)
    finally:
        cloudpickle.unregister_pickle_by_value(module)
    options = {
        "fetcher": cloudpickle.dumps(fetcher).hex(),
        "records_key": records_key,
        "limit": limit,
        "readers": max(1, readers),
        "fetch_all": str(fetch_all).lower(),
    }
    return spark.read.format("paged_records").options(**{k: v for k, v in options.items() if v is not None}).load()


def within_end(pages: DataFrame, limit: int | None) -> DataFrame:
    """Rows of pages up to the first short one: what lies behind the end of a source is not part of it."""
    if limit is None:
        return pages
    end = pages.where(F.col("n_pagina") < limit).agg(F.min("offset").alias("_end"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    inside = F.col("_end").isNull() | (F.col("offset") <= F.col("_end"))
    return one(pages).join(F.broadcast(one(end)), "_one").where(inside).drop("_end", "_one")


def typed(records: DataFrame, column: str) -> DataFrame:
    """The records of a VARIANT column as a table whose columns and types come from the data: one aggregation over all
    records, then a typed read. A field that some records lack is NULL there; records that are no objects become ``valor``."""
    found = records.agg(F.schema_of_variant_agg(column).alias("s")).first()["s"]
    kind = plain_type(found or "VOID")
    if found in (None, "VOID"):
        return records.sparkSession.createDataFrame([], T.StructType())
    value = F.try_variant_get(column, "$", ddl(kind))
    if isinstance(kind, T.StructType):
        return records.select(value.alias("_r")).select("_r.*")
    return records.select(value.alias("valor"))


def records_of(pages: DataFrame, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """Typed records of :func:`fetch_pages`; if any page failed, no record at all, as for an empty source.

    Without ``schema`` columns and types come from the records, see :func:`typed`.
    """
    pages = within_end(pages, limit)
    failed = pages.where(F.col("error").isNotNull()).select(F.lit(1).alias("_failed")).limit(1)
    read = F.try_parse_json("registro") if schema is None else F.from_json("registro", schema)
    good = pages.where(F.col("registro").isNotNull()).select(read.alias("_r"), F.lit(1).alias("_failed"))
    kept = good.join(F.broadcast(failed), "_failed", "left_anti")
    return typed(kept, "_r") if schema is None else kept.select("_r.*")


def read_status(pages: DataFrame, name: str, limit: int | None = None, fetch_all: bool = False) -> DataFrame:
    """One row ``(fuente, n_registros, estado, aviso)``; ``aviso`` tells of an error or of unread pages."""
    row = within_end(pages, limit).agg(F.count("registro").alias("_n"), F.max("error").alias("_error"))
    full = F.lit(False) if limit is None or fetch_all else F.col("_n") >= limit
    n = F.when(F.col("_error").isNull(), F.col("_n")).otherwise(F.lit(0))
    return row.select(
        F.lit(name).alias("fuente"),
        n.alias("n_registros"),
        F.when(n > 0, "OK").otherwise("ERROR").alias("estado"),
        F.coalesce("_error", F.when(full, "puede haber más registros")).alias("aviso"),
    )


def page_number(path: Column) -> Column:
    """The last number in a file's name, for ``page_2`` to come before ``page_10``; 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))


def read_landed_pages(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    records_key: str | None = None,
    first_only: bool = False,
    number: Callable[[Column], Column] = page_number,
    lines: bool = False,
) -> DataFrame:
    """Records of a folder of page files (one JSON document each): every page, whole, in any order of names.

    With ``lines`` a file holds many pages, one JSON document a line, as a file for every small page costs more than its rows.
    ``first_only`` mirrors a single request: only the pages with the smallest ``number`` of their path. ``schema`` is
    that of one record; without it columns and types come from all records, see :func:`typed`.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    infer, schema = schema is None, schema or T.VariantType()
    array = T.ArrayType(schema)
    files = spark.read.text(path, lineSep="\n") if lines else spark.read.text(path, wholetext=True)
    pages = files.select(number(F.input_file_name()).alias("_page"), "value")
    if first_only:
        first = pages.agg(F.min("_page").alias("_page"))
        pages = pages.join(F.broadcast(first), "_page")
    if records_key:
        body = T.StructType([T.StructField(records_key, array)])
        single = T.StructType([T.StructField(records_key, schema)])
        many = F.from_json("value", body)[records_key]
        one = F.from_json("value", single)[records_key]
    else:
        many, one = F.from_json("value", array), F.from_json("value", schema)
    inner = F.get_json_object("value", f"$.{records_key}") if records_key else F.col("value")
    is_list = F.ltrim(inner).startswith("[")
    records = pages.select(F.explode(F.when(is_list, many).otherwise(F.array(one))).alias("_r"))
    return typed(records, "_r") if infer else records.select("_r.*")


def read_api_records(
    spark: SparkSession,
    source: str | Fetcher,
    schema: T.StructType | str | None = None,
    records_key: str | None = None,
    limit: int | None = None,
    fetch_all: bool = False,
    total: int | None = None,
    lines: bool = False,
) -> DataFrame:
    """Records from landed page files (a path: all of them; with ``lines`` one page a line) or from a fetcher; an error gives an empty table.

    Without ``schema`` the columns are those of the records, with types that hold every page's values. Fetched pages are written to the checkpoint folder first, so each page is asked for once.
    """
    if isinstance(source, str):
        return read_landed_pages(spark, source, schema, records_key, lines=lines)
    return records_of(settle(fetch_pages(spark, source, records_key, limit, fetch_all, total)), schema, limit if fetch_all else None)

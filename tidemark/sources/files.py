"""Reading tables from files and catalogs, and writing query results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_FORMATS = ("csv", "parquet")
CATALOG_FORMATS = ("hive", "iceberg", "tidb", "table")
MODES = {"error_if_exists": "errorifexists", "errorifexists": "errorifexists", "error": "errorifexists", "overwrite": "overwrite", "append": "append"}

#: Options of loading that don't change what is loaded.
WITHOUT_EFFECT = {"thread", "writer_type", "load_mode", "skip_cvt"}


@dataclass(frozen=True)
class Options:
    """Options of loading and writing; ``delimiter``, ``header``, ``null_value`` and ``quote`` are of csv."""

    format: str = "csv"
    delimiter: str = ","
    header: bool = True
    null_value: str = "null"
    quote: str = "\0"
    mode: str = "error_if_exists"
    deep_copy: bool = True
    coalesce: int = 0
    sql: str = ""
    put_if_absent: bool = False

    @classmethod
    def of(cls, given: dict) -> Options:
        """Options as a statement gives them; one that isn't served is an error, but for those that only say how a loader of its own would work."""
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__}
        if unknown := sorted(set(given) - set(known) - WITHOUT_EFFECT):
            raise ValueError(f"options {unknown} aren't served")
        if "mode" in known and known["mode"] not in MODES:
            raise ValueError(f"unknown mode {known['mode']}")
        return cls(**known)


def parsed(text: Column, kind: T.DataType) -> Column:
    """A csv field as its type, NULL if it isn't of it; a timestamp may be milliseconds or written out, row by row."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = text.try_cast("bigint")
        return F.when(number.isNotNull(), F.timestamp_millis(number)).otherwise(text.try_cast("timestamp")).cast(kind)
    if isinstance(kind, T.BooleanType):
        from tidemark.functions.scalar import bool_

        return bool_(text)
    return text.try_cast(kind)


def read(spark: SparkSession, path: str, options: Options = Options(), schema: T.StructType | None = None) -> DataFrame:
    """A table from files (csv, parquet) or from a catalog table of that name.

    With a schema, csv fields are read as text and converted, so that a bad field is NULL instead of a failed
    job; parquet columns are taken by name and cast, and only those columns are read.
    """
    if options.format in CATALOG_FORMATS:
        out = spark.table(path)
    elif options.format == "parquet":
        out = spark.read.parquet(path)
    elif options.format == "csv":
        reader = spark.read.options(sep=options.delimiter, header=options.header, nullValue=options.null_value, quote=options.quote)
        if schema is None:
            return reader.csv(path, inferSchema=True)
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        return reader.schema(text).csv(path).select(*[parsed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema])
    else:
        raise ValueError(f"unknown format {options.format}")
    if schema is None:
        return out
    missing = [f.name for f in schema if f.name not in out.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return out.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if isinstance(out.schema[f.name].dataType, T.StringType) else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write(df: DataFrame, path: str, options: Options = Options()) -> None:
    """Writes a result; ``coalesce`` limits the number of files, 0 leaves the plan's own."""
    if options.coalesce:
        df = df.coalesce(options.coalesce)
    writer = df.write.mode(MODES[options.mode])
    if options.format == "csv":
        more = {} if options.quote == "\0" else {"quote": options.quote}
        writer.options(sep=options.delimiter, header=options.header, nullValue=options.null_value, **more).csv(path)
    elif options.format == "parquet":
        writer.parquet(path)
    elif options.format in CATALOG_FORMATS:
        writer.saveAsTable(path)
    else:
        raise ValueError(f"unknown format {options.format}")

"""CSV and JSON files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hygroflow.session import Files, shared_folder


#: A quote inside a text is doubled and white space stays.  NULL is an empty field and an
#: empty text is "".  Texts may hold line breaks, so one file is read by one task: write many.
FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
WRITTEN = FORMAT | {"nullValue": "", "emptyValue": '""'}
#: The parser hands out the first for an empty field, the second for "".
READ = FORMAT | {"nullValue": "\x00", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred only when no schema is given."""
    reader = spark.read.options(**READ)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def first_column(df: DataFrame, name: str = "company") -> DataFrame:
    """The first column by position, as text."""
    return df.select(F.col(f"`{df.columns[0]}`").cast("string").alias(name))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode("overwrite").options(**WRITTEN).csv(path)


def write_chart(df: DataFrame, path: str) -> None:
    """Tidy chart table as JSON lines; missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def in_order(df: DataFrame, position: str = "position") -> DataFrame:
    """Rows dealt to partitions by ranges of their position, sorted: files of a sink then follow each other."""
    return df.repartitionByRange(F.col(position)).sortWithinPartitions(position)


def csv_roundtrip(df: DataFrame) -> DataFrame:
    """Write a table as CSV under the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(df, path)
    Files(spark).delete_on_exit(path)
    schema = StructType([StructField(f.name, f.dataType, True) for f in df.schema])
    return read_csv(spark, path, schema)

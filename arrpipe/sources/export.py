"""CSV export."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header, written by the tasks that hold the rows.

    Quotes are doubled, blanks at either end of a value are kept, and NULL is written as
    an empty field, "" as quoted empty text.
    """
    df.write.mode("overwrite").options(**_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read an export back under the schema of ``like``."""
    text = spark.read.options(**_OPTIONS, multiLine=True).csv(path)
    return text.select(*(F.col(f.name).cast(f.dataType) for f in like.schema.fields))

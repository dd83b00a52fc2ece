"""Tolerant numeric casts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: decimal text with optional sign, exponent and single underscores between digits.
_NUMBER = (
    r"^[\s]*[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+)?[\s]*$"
)


def to_int_sql(x: str) -> str:
    number = f"try_cast(replace({x}, '_', '') as double)"
    return f"case when {x} rlike r'{_NUMBER}' then try_cast(rint({number}) as int) end"


def to_int(col: str) -> Column:
    """Numeric text to integer, halves to even; anything else, or out of range, is NULL."""
    return F.expr(to_int_sql(col))

"""Schema gates: which landing files may be loaded, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ARTICLE_COLUMNS, COMPANY_FIELDS, COMPANY_VALUE

# Fixed formats: the reasons written to the file log.
_CSV_REASON = "Schema mismatch. Missing columns: %s. Found: %s."
_NOT_AN_OBJECT = "Schema mismatch. Expected an object keyed by company_name."
_NOT_OBJECT_VALUE = "Schema mismatch for company '%s': value must be an object."
_MISSING_FIELDS = "Schema mismatch for company '%s'. Missing fields: %s."
_WRONG_TYPE = "Schema mismatch for company '%s'. Wrong type: %s."
_INVALID_JSON = "Invalid JSON"

# JSON types a field may have, by its Spark type; VOID is JSON null. Text fields take any value as text.
_JSON_TYPES = {"int": "BIGINT", "boolean": "BOOLEAN"}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _as_list(names: Column) -> Column:
    """A string array as text: ['a', 'b']."""
    quoted = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def check_headers(headers: DataFrame) -> DataFrame:
    """Add ``reason`` to (path, names): NULL if all article columns are there, in any order."""
    present = F.transform("names", lambda n: F.regexp_replace(n, r"^\s+|\s+\z", ""))
    missing = F.array_except(_strings(ARTICLE_COLUMNS), present)
    reason = F.printf(F.lit(_CSV_REASON), _as_list(missing), _as_list(F.col("names")))
    return headers.withColumn("reason", F.when(F.size(missing) > 0, reason))


def _wrong_type(field: str, kind: str) -> Column:
    """Whether a field's JSON value isn't of its type, or a whole number of more than 32 bits."""
    value = F.variant_get("v", f"$.{field}", "variant")
    named = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    wrong = ~named.isin("VOID", _JSON_TYPES[kind])
    if kind == "int":
        number = F.try_variant_get("v", f"$.{field}", "bigint")
        wrong = wrong | F.coalesce(~number.between(-(2**31), 2**31 - 1), F.lit(False))
    return wrong


def check_companies(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (path, entries, is_json) into (path, reason) of bad files and rows of good ones.

    A file is loaded whole or not at all; its first violation is the reason.
    """
    not_an_object = F.when(
        F.col("entries").isNull(),
        F.when(F.col("is_json"), _NOT_AN_OBJECT).otherwise(_INVALID_JSON),
    ).when(F.size("entries") == 0, _NOT_AN_OBJECT)
    whole = objects.select("path", F.lit(-1).alias("at"), not_an_object.alias("reason"))

    entries = objects.select(
        "path", F.posexplode("entries").alias("at", "company_name", "value")
    ).withColumn("v", F.try_parse_json("value"))
    fields = F.json_object_keys("value")  # NULL unless an object
    missing = F.array_except(_strings(COMPANY_FIELDS), fields)
    wrong = F.array_compact(
        F.array(
            *(
                F.when(_wrong_type(f.name, f.dataType.simpleString()), F.lit(f.name))
                for f in COMPANY_VALUE.fields
                if f.dataType.simpleString() in _JSON_TYPES
            )
        )
    )
    name = F.col("company_name")
    reason = (
        F.when(fields.isNull(), F.printf(F.lit(_NOT_OBJECT_VALUE), name))
        .when(F.size(missing) > 0, F.printf(F.lit(_MISSING_FIELDS), name, _as_list(missing)))
        .when(F.size(wrong) > 0, F.printf(F.lit(_WRONG_TYPE), name, _as_list(wrong)))
    )
    bad = (
        whole.unionByName(entries.select("path", "at", reason.alias("reason")))
        .where("reason is not null")
        .groupBy("path")
        .agg(F.min_by("reason", "at").alias("reason"))
    )
    rows = (
        entries.select("path", "company_name", F.from_json("value", COMPANY_VALUE).alias("c"))
        .join(bad, "path", "left_anti")
        .select("path", "company_name", "c.*")
    )
    return bad, rows

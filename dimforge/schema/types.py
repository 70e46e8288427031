"""Column types: how they are stored, how loose input text is coerced, how values are written out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimforge.functions import yamlish

#: Declared type to Spark type.
SPARK = {
    "integer": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "money": T.DecimalType(19, 2), "string": T.StringType(), "uuid": T.StringType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "boolean": T.BooleanType(), "sequence": T.LongType(), "enum": T.StringType(),
    "key_value": T.MapType(T.StringType(), T.StringType()), "json": T.StringType(), "yaml": T.StringType(),
}

#: Which declared types may stand for each other when columns are matched (from, to).
_COMPATIBLE = {("key_value", "yaml"), ("key_value", "json"), ("yaml", "json")}


def compatible(a: str, b: str) -> bool:
    return a == b or (a, b) in _COMPATIBLE


def spark_type(kind: str, array: bool = False) -> T.DataType:
    if kind not in SPARK:
        raise ValueError(f"unknown column type {kind}")
    return T.ArrayType(SPARK[kind]) if array else SPARK[kind]


# The functions a default may name.
_FUNCTIONS = {
    "uuid()": lambda: F.uuid(), "uuid_generate_v4()": lambda: F.uuid(),
    "now()": lambda: F.localtimestamp(), "current_timestamp()": lambda: F.localtimestamp(), "epoch()": lambda: F.lit("1970-01-01").cast("timestamp_ntz"),
}


def default_value(default: object, kind: str, array: bool = False) -> Column:
    """A declared default as a column: a value, or what the function that it names gives for each row."""
    if isinstance(default, str) and default.endswith("()"):
        if default.lower() not in _FUNCTIONS:
            raise ValueError(f"unknown default {default}")
        return _FUNCTIONS[default.lower()]().cast(spark_type(kind, array))
    return F.lit(default).cast(spark_type(kind, array))


def _yaml_text(text: str | None) -> str | None:
    if text is None or not text.strip():
        return "{}"
    got = yamlish.mapping(text)
    return None if got is None else json.dumps(got, ensure_ascii=False, default=str)


@F.pandas_udf(T.StringType())
def _yaml_as_json(texts: pd.Series) -> pd.Series:
    return texts.map(_yaml_text)


def _blank_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def coerce(c: Column, kind: str, array: bool = False, values: tuple[str, ...] = ()) -> Column:
    """Input text as a value of `kind`; null where it is blank or can't be one.

    integer: the leading digits, junk gives 0. boolean: 0, false / 1, true in any case, else null.
    timestamp: all digits are epoch seconds, else ISO text. json and yaml: JSON text of an object or
    array, {} for none. An array is a JSON list (null if it starts like one but isn't); a bare scalar is a list of one, none an empty list.
    """
    spark_type(kind)
    text = c.cast("string")
    if array:
        scalar = spark_type(kind).simpleString()
        listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, f"array<{scalar}>"))
        none = F.from_json(F.lit("[]"), f"array<{scalar}>")
        return F.when(_blank_null(text).isNull(), none).when(text.rlike(r"^\s*\["), listed).otherwise(F.array(coerce(text, kind, values=values)))
    if kind in ("integer", "long", "sequence"):
        digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
        return F.when(_blank_null(text).isNotNull(), F.when(digits == "", F.lit(0)).otherwise(digits.try_cast(SPARK[kind]))).cast(SPARK[kind])
    if kind == "boolean":
        t = F.lower(F.translate(F.trim(text), "'", ""))
        return F.when(t.isin("0", "false"), False).when(t.isin("1", "true"), True)
    if kind == "timestamp":
        return F.when(text.rlike(r"^\s*\d+\s*$"), F.to_timestamp_ntz(F.timestamp_seconds(text.try_cast("long")).cast("string"))).otherwise(_blank_null(text).try_cast("timestamp").cast("timestamp_ntz"))
    if kind == "json":
        return F.when(_blank_null(text).isNull(), F.lit("{}")).when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), text)
    if kind == "yaml":
        return _yaml_as_json(text)
    if kind == "key_value":
        whole = F.coalesce(_blank_null(text), F.lit("{}"))
        return F.when(F.try_parse_json(whole).isNotNull(), F.from_json(whole, "map<string,string>"))
    if kind == "enum":
        return F.when(text.isin(*values), text) if values else _blank_null(text)
    if kind in ("string", "uuid"):
        return _blank_null(text)
    return _blank_null(text).try_cast(SPARK[kind])


def encode(c: Column, kind: str, array: bool = False, store: str = "postgres") -> Column:
    """A value as text for a file: times ISO-8601 with milliseconds, lists and maps as JSON, null as the store writes it.

    On hive stores false is written as null, as an empty text is everywhere.
    """
    if array or kind in ("key_value",):
        text = F.to_json(c)
        return F.coalesce(text, F.lit("NULL")) if store == "hive" else text
    if kind == "timestamp":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif kind == "boolean":
        text = F.when(c, "TRUE").when(~c, F.lit(None) if store == "hive" else F.lit("FALSE"))
    else:
        text = _blank_null(c.cast("string"))
    return F.coalesce(text, F.lit("\\N")) if store == "hive" else text

"""Looking up parameters in the typed parameter lists of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.functions.formats import choose_format, formats_of, plain_text

# Fixed pattern: ``name[index]``, greedy, over the whole text.
PATH_PATTERN = r"^([\s\S]*)\[(\d+)\]$"

EVENT_MISSING = "EVENT_MISSING"
PARAM_MISSING = "PARAM_MISSING"
INDEX_OUT_OF_RANGE = "INDEX_OUT_OF_RANGE"
ATTRIBUTE_UNSUPPORTED = "ATTRIBUTE_UNSUPPORTED"


def matching(params: Column, key_name: Column | str) -> Column:
    """The elements of a typed parameter list that carry the key name."""
    name = F.lit(key_name) if isinstance(key_name, str) else key_name
    return F.filter(params, lambda p: p["keyName"] == name)


def value_at(params: Column, key_name: Column | str, index: Column | int = 0) -> Column:
    """The value at ``index`` of the first matching parameter, null if there is none."""
    position = F.lit(index) if isinstance(index, int) else index
    first = F.get(matching(params, key_name), F.lit(0))
    return F.get(first["values"], position)


def path_name(path: Column) -> Column:
    """``name`` of ``name[3]``; the whole text when there is no index."""
    return F.when(path.rlike(PATH_PATTERN), F.regexp_extract(path, PATH_PATTERN, 1)).otherwise(path)


def path_index(path: Column) -> Column:
    """``3`` of ``name[3]``; 0 without an index; null when it does not fit an int."""
    digits = F.regexp_extract(path, PATH_PATTERN, 2)
    return F.when(path.rlike(PATH_PATTERN), digits.try_cast("int")).when(path.isNotNull(), 0)


def has_name(key_name: Column) -> Column:
    """False for a null parameter name and for one of white space alone, of any script."""
    return F.coalesce(key_name.rlike(r"(?U)\S"), F.lit(False))


def value_type(param_set: T.StructType, type_key: str) -> T.DataType:
    """Type of one value of a parameter type key."""
    return param_set[type_key].dataType.elementType["values"].dataType.elementType


def _long_rows(params: Column, type_key: str, kind: T.DataType) -> Column:
    def one(p: Column) -> Column:
        return F.struct(
            F.lit(type_key).alias("type"),
            p["keyName"].alias("key_name"),
            p["units"].alias("units"),
            F.transform(p["values"], lambda v: plain_text(v, kind)).alias("values"),
        )

    return F.coalesce(F.transform(params, one), F.array().cast(_LONG_TYPE))


_LONG_TYPE = "array<struct<type:string,key_name:string,units:string,values:array<string>>>"


def all_params(params: Column, param_set: T.StructType) -> Column:
    """One array with the parameters of every type, values as text."""
    return F.concat(
        *[
            _long_rows(params[key], key, value_type(param_set, key)).cast(_LONG_TYPE)
            for key in param_set.fieldNames()
        ]
    )


def _outcome(type_key: str, kind: T.DataType, index: Column, attribute: Column):
    def one(p: Column) -> Column:
        item = F.get(p["values"], index)
        text = choose_format(formats_of(type_key, item, kind), attribute)
        out_of_range = F.coalesce((index < 0) | (index >= F.size(p["values"])), F.lit(True))
        reason = (
            F.when(out_of_range, INDEX_OUT_OF_RANGE)
            .when(item.isNull(), PARAM_MISSING)
            .when(text.isNull(), ATTRIBUTE_UNSUPPORTED)
        )
        return F.struct(F.when(reason.isNull(), text).alias("value"), reason.alias("reason"))

    return one


def lookup(params: Column, param_set: T.StructType, key_name: Column, index: Column, attribute: Column) -> Column:
    """Text of one parameter value, or the reason there is none, as ``struct<value, reason>``.

    Searches the types in schema order and takes the first that holds the name.
    """
    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(PARAM_MISSING).alias("reason"))
    by_type = [
        F.get(
            F.transform(
                matching(params[type_key], key_name),
                _outcome(type_key, value_type(param_set, type_key), index, attribute),
            ),
            F.lit(0),
        )
        for type_key in param_set.fieldNames()
    ]
    return F.when(has_name(key_name), F.coalesce(*by_type, missing)).otherwise(missing)

"""Narrow metadata columns to the scalar types a collection accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_KEEP = (T.StringType, T.NumericType, T.BooleanType, T.NullType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def clean_meta(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Strings, numbers, booleans and nulls stay; nested values become JSON, the rest text.

    Columns named in ``keep`` (the vector, for one) are left alone.
    """

    def narrow(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if field.name in keep or isinstance(field.dataType, _KEEP):
            return col
        if isinstance(field.dataType, _NESTED):
            return F.to_json(col).alias(field.name)
        return col.cast("string").alias(field.name)

    return df.select(*[narrow(f) for f in df.schema.fields])

"""Functions over columns. Types are objects, as a module may load where no session is."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

STRING, STRINGS, INTS = StringType(), ArrayType(StringType()), ArrayType(IntegerType())


def record(**fields: DataType) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out

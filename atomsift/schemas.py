"""Schemas of the tables that travel between the stages."""

from pyspark.sql import types as T

PROVENANCE = T.StructType(
    [
        T.StructField("file_id", T.IntegerType()),
        T.StructField("struct_id", T.IntegerType()),
        T.StructField("atom_id", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("is_fixed", T.BooleanType()),
        T.StructField("source_struct_id", T.IntegerType()),
    ]
)

FILEMAP = T.StructType(
    [T.StructField("file_id", T.IntegerType()), T.StructField("file_path", T.StringType())]
)

ATOM = T.StructType(
    [
        T.StructField("atom_id", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("pos", T.ArrayType(T.DoubleType())),
        T.StructField("force", T.ArrayType(T.DoubleType())),
        T.StructField("is_fixed", T.BooleanType()),
    ]
)

FRAME = T.StructType(
    [
        T.StructField("cell", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("pbc", T.ArrayType(T.BooleanType())),
        T.StructField("energy", T.DoubleType()),
        T.StructField("atoms", T.ArrayType(ATOM)),
    ]
)

MATRIX = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
)

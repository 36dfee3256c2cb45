"""Schemas of the tables that operators exchange."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
STRUCTURES = T.StructType(
    [
        T.StructField("structure_id", T.LongType()),
        T.StructField("charges", VECTOR),
        T.StructField("coords", T.ArrayType(VECTOR)),
        T.StructField("cell", T.ArrayType(VECTOR)),
        T.StructField("pbc", T.StructType([T.StructField(a, T.BooleanType()) for a in "abc"])),
        T.StructField("target", T.DoubleType()),
    ]
)
ATOMS = "structure_id bigint, atom_id int, z int, x double, y double, zc double"

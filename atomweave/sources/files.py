"""Reading and writing structures and results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STRUCTURES

#: Atomic numbers of the elements of small organic molecules.
NUMBERS = {"H": 1, "C": 6, "N": 7, "O": 8, "F": 9}


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STRUCTURES).parquet(path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Frames of one molecule: energy, forces, positions."""
    return spark.read.schema("frame bigint, E double, F array<array<double>>, R array<array<double>>, z array<int>").parquet(path)


def trajectory_frames(frames: DataFrame, structure_id: int = 0) -> DataFrame:
    """Frames (frame, E, R, z) of one molecule as STRUCTURES with a column frame: no periodic axis, a cell of unit length, the energy as target."""
    unit = F.array(*[F.array(*[F.lit(float(a == b)) for b in range(3)]) for a in range(3)])
    pbc = F.struct(*[F.lit(False).alias(a) for a in "abc"])
    return frames.select(F.lit(structure_id).cast("long").alias("structure_id"), "frame", F.col("z").cast("array<double>").alias("charges"), F.col("R").alias("coords"), unit.alias("cell"), pbc.alias("pbc"), F.col("E").alias("target"))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def target_column(df: DataFrame) -> str:
    """The first column that isn't the structure."""
    return next(c for c in df.columns if c not in ("structure", "structure_id"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def parse_xyz(text: Column) -> Column:
    """Struct (charges, coords, energy) of a molecule in XYZ text: a count, a line of tab-separated properties of which number 12
    is the energy, a line per atom. Exponents may be written *^. Null if a line can't be read."""
    number = lambda s: F.regexp_replace(F.trim(s), r"\*\^", "e").try_cast("double")
    symbols = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])

    def atom(line: Column) -> Column:
        return _let(F.split(line, "\t"), lambda r: F.struct(F.try_element_at(symbols, F.trim(F.get(r, F.lit(0)))).cast("double").alias("z"), F.array(*[number(F.get(r, F.lit(k))) for k in (1, 2, 3)]).alias("p")))

    def molecule(m: Column) -> Column:
        good = m["n"].isNotNull() & m["energy"].isNotNull() & (F.size(m["atoms"]) == m["n"]) & F.forall(m["atoms"], lambda a: a["z"].isNotNull() & F.forall(a["p"], lambda x: x.isNotNull()))
        return F.when(good, F.struct(F.transform(m["atoms"], lambda a: a["z"]).alias("charges"), F.transform(m["atoms"], lambda a: a["p"]).alias("coords"), m["energy"].alias("energy")))

    def read(lines: Column) -> Column:
        n = F.trim(lines[0]).try_cast("int")
        energy = number(F.get(F.split(F.get(lines, F.lit(1)), "\t"), F.lit(12)))
        atoms = F.transform(F.slice(lines, F.lit(3), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))), atom)
        return _let(F.struct(n.alias("n"), energy.alias("energy"), atoms.alias("atoms")), molecule)

    return _let(F.split(text, "\n"), read)


def parsed(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns to keep and the molecule (charges, coords, energy) of rows whose text can be read; each text is parsed once."""
    return rows.select(*keep, F.explode(F.filter(F.array(parse_xyz(text)), lambda m: m.isNotNull())).alias("m")).select(*keep, "m.*")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(path, charges, coords, energy) of the files that can be read; the others are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parsed(rows, F.col("value"), "path")


def cached(spark: SparkSession, folder: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of these parameters below folder; computed and written if it isn't there."""
    path = f"{folder}/{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        write(make(), path)
    return spark.read.parquet(path)

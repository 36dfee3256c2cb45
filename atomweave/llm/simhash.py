"""SimHash near-duplicates found through a pivot distance table.

Fingerprints: lower-cased words, shingles of WIDTH words, XXH64 of each, majority of every bit (numpy on Arrow batches; the
hashes of a long text are counted in slices of 65,536).

Search, over distinct fingerprints, so that copies are one row from the start:
1. The pivot table holds the Hamming distances of each fingerprint to N_PIVOTS reference fingerprints.
2. Its rows are dealt to places where they can meet: the 64 bits are cut into N_RANGES ranges, and two fingerprints at up to 2
   bits agree in all but 2 of them, so each row goes to the 6 choices of 2 of 4 ranges (32 bits). The distances alone can't deal all
   rows (they spread by 4 around 32 for any reference, so bands of them would leave a constant share of all pairs together).
3. A place of more than MOST_A_PLACE fingerprints is divided by the table before any pair exists: by one coordinate after another its rows go to bands of
   3 distances, each to its own band and, if it is within 2 of the next, to that one too; so two rows that differ by at most 2 in the coordinate still
   meet. It ends when no more than MOST_A_PLACE are left, or after DIVISIONS coordinates.
4. Pairs at a place are discarded if any coordinate of their table rows differs by more than 2 (by the triangle inequality
   none of them links), and the survivors are verified by bit count. search_report counts both.
5. What is still crowded then (a cluster denser than any distance table can tell apart) makes no pairs. Its fingerprints are linked through
   the 65 points within a bit of each, which at most 65 share: exact as well, and linear.
Components of the links follow by alternating stars.

Defined results: null or wordless texts have fingerprint 0 and link like any other; null identifiers take part and never
become a component's name (null if a component has no other); repeated rows each get their row; an empty table gives an
empty result; other columns are never read, and drop_near returns them whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, inner, located, only, told
from .components import components

WIDTH = 3
N_PIVOTS = 16
N_RANGES = 4
DIVISIONS = 4
MOST_A_PLACE = 256
MOST_BITS = 2
TIES = ["__tie", "__tie2"]


def fingerprint(text: str, width: int = WIDTH) -> int:
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < width:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def text_hashes(text_col: str) -> list[Column]:
    """Two hashes of a text of different seeds, which tell texts apart; null isn't the empty text."""
    return [F.xxhash64(F.col(text_col)).alias("__tie"), F.xxhash64(F.lit(7), F.col(text_col)).alias("__tie2")]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, also: list[str] | None = None, ties: bool = False) -> DataFrame:
    """(identifier as __id, __fp as a signed long) of every row, and more columns of longs; with ties also the two hashes of the text, __tie and __tie2."""
    more = [*(also or []), *(TIES if ties else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.array([fingerprint(t or "", width) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]], names=["__id", "__fp", *more])

    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *(also or []), *(text_hashes(text_col) if ties else []))
    return rows.mapInArrow(each, ", ".join(f"{c} long" for c in ["__id", "__fp", *more]))


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: fixed pseudo-random longs."""
    return [int(x) for x in np.random.default_rng(64).integers(-(2**63), 2**63 - 1, n)]


def pivot_table(distinct: DataFrame, refs: list[int]) -> DataFrame:
    """(__fp, __t0, __t1, ...): the Hamming distances of each fingerprint to the reference fingerprints, eight to a long."""
    far = [F.shiftleft(F.bit_count(F.col("__fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * (k % 8)) for k, p in enumerate(refs)]
    return distinct.select("__fp", *[functools.reduce(Column.bitwiseOR, far[k : k + 8]).alias(f"__t{k // 8}") for k in range(0, len(refs), 8)])


def coordinate(side: str, k: int) -> Column:
    return F.shiftright(F.col(f"{side}.__t{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_ranges(n: int) -> list[int]:
    """64 bits cut into n neighbouring ranges, as masks."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def dealt(table: DataFrame) -> DataFrame:
    """The table's rows once for each choice of all but MOST_BITS of N_RANGES bit ranges (__which), by what the fingerprint has in them (__key).
    Two fingerprints at up to MOST_BITS bits share at least one such place."""
    masks = [sum(m) for m in itertools.combinations(bit_ranges(N_RANGES), N_RANGES - MOST_BITS)]
    places = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("__which"), F.col("__fp").bitwiseAND(F.lit(signed(m))).alias("__key")) for k, m in enumerate(masks)])
    return table.withColumn("__place", F.explode(places)).select("__place.*", *table.columns)


def survives(n: int) -> Column:
    """The largest difference of two table rows (a and b) in any coordinate is at most MOST_BITS."""
    return functools.reduce(operator.and_, [F.abs(coordinate("a", k) - coordinate("b", k)) <= MOST_BITS for k in range(n)])


PLACE = ["__which", "__key", "__path"]


def meeting(rows: DataFrame) -> DataFrame:
    """rows of places with __n, the number of the place's rows, only where two or more meet."""
    return checkpointed(rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*PLACE))).filter("__n > 1"))


def divided(rows: DataFrame, k: int) -> DataFrame:
    """Rows of places by bands of coordinate k: each goes to the band of its distance and to that of its distance plus MOST_BITS, mostly the same."""
    width, c = MOST_BITS + 1, coordinate("rows", k)
    bands = F.array_distinct(F.array(F.floor(c / width), F.floor((c + MOST_BITS) / width)))
    own = rows.alias("rows").withColumn("__band", F.explode(bands))
    return own.withColumn("__path", F.shiftleft("__path", 5).bitwiseOR(F.col("__band") + 1)).drop("__band", "__n")


def places_of(distinct: DataFrame, refs: list[int], most: int) -> tuple[DataFrame, DataFrame]:
    """The pivot table's rows dealt to their places, only where two or more meet: (those of up to most rows, the fingerprints that are in larger ones after all divisions)."""
    near = meeting(dealt(pivot_table(distinct, refs)).withColumn("__path", F.lit(0).cast("long")))
    small, crowded = near.filter(F.col("__n") <= most), near.filter(F.col("__n") > most)
    for k in range(min(DIVISIONS, len(refs))):
        if crowded.limit(1).count() == 0:
            break
        near = meeting(divided(crowded, k))
        small, crowded = small.unionByName(near.filter(F.col("__n") <= most)), near.filter(F.col("__n") > most)
    return small, crowded.select("__fp").distinct()


def met(small: DataFrame) -> DataFrame:
    """Pairs (a, b) of table rows at one place."""
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in PLACE]
    return small.alias("a").join(small.alias("b"), functools.reduce(operator.and_, same) & (F.col("a.__fp") < F.col("b.__fp")))


def bits_apart() -> Column:
    return F.bit_count(F.col("a.__fp").bitwiseXOR(F.col("b.__fp")))


def midpoint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of crowded places, linear in their number: two at up to 2 bits share one of the 65 points within a bit of each,
    and each fingerprint is linked to the first that shares a point. At most 65 share one."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)])
    near = distinct.select("__fp", F.explode(flips).alias("__flip")).select("__fp", F.col("__fp").bitwiseXOR(F.col("__flip")).alias("__mid"))
    first = F.min("__fp").over(Window.partitionBy("__mid"))
    pairs = near.withColumn("__first", first).filter((F.col("__first") != F.col("__fp")) & (F.bit_count(F.col("__fp").bitwiseXOR(F.col("__first"))) <= MOST_BITS))
    return pairs.select(F.col("__fp").alias("a"), F.col("__first").alias("b"))


def links(distinct: DataFrame, refs: list[int], most: int = MOST_A_PLACE) -> DataFrame:
    """Links (a, b) between fingerprints __fp (distinct) at up to MOST_BITS bits that connect all that such pairs connect."""
    small, crowded = places_of(distinct, refs, most)
    pairs = met(small).filter(survives(len(refs))).filter(bits_apart() <= MOST_BITS).select(F.col("a.__fp").alias("a"), F.col("b.__fp").alias("b"))
    return pairs.union(midpoint_links(crowded))


def search_report(distinct: DataFrame, refs: list[int], most: int = MOST_A_PLACE) -> DataFrame:
    """One row on the search: pairs that met, that the table discarded, that were verified, that link; fingerprints of crowded places."""
    small, crowded = places_of(distinct, refs, most)
    pairs = met(small).select(survives(len(refs)).alias("s"), (bits_apart() <= MOST_BITS).alias("l"))
    counts = pairs.agg(F.count(F.lit(1)).alias("met"), F.count_if(~F.col("s")).alias("discarded"), F.count_if("s").alias("verified"), F.count_if(F.col("s") & F.col("l")).alias("linked"))
    return counts.crossJoin(crowded.agg(F.count(F.lit(1)).alias("crowded")))  # one row each


def rooted(rows: DataFrame, least: Column) -> DataFrame:
    """Of rows with __fp: (__fp, root, __n, component_id) by distinct fingerprint; __n counts its rows, component_id is the minimum of least over the rows of the component."""
    distinct = checkpointed(rows.groupBy("__fp").agg(F.min(least).alias("__least"), F.count(F.lit(1)).alias("__n")))
    comp = components(links(distinct, pivots()))
    named = distinct.withColumnRenamed("__n", "__rows").join(comp.withColumnRenamed("node", "__fp"), "__fp", "left").withColumn("root", F.coalesce("root", "__fp"))
    named = checkpointed(named)
    names = checkpointed(named.groupBy("root").agg(F.min("__least").alias("component_id"), F.count(F.lit(1)).alias("__n")))
    return checkpointed(told(named, names, ["root"]).select("__fp", "root", F.col("__rows").alias("__n"), "component_id"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of df: identifier, fingerprint (16 hex digits), component_id."""
    rows = checkpointed(fingerprints(df, id_col, text_col, width))
    out = told(rows, rooted(rows, F.col("__id")).drop("root"), ["__fp"])
    return out.select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of df of each component, with all its columns: the least identifier (null after all others), then the least hash of the text, then the first read.

    Rows are told apart by a number of their own, so rows without identifier, or texts that share one, don't stand for each other.
    """
    own = located(df)
    light = own.select(inner(id_col).cast("long").alias("__id"), inner(text_col).alias("__text"), "__at")
    rows = checkpointed(fingerprints(light, "__id", "__text", width, also=["__at"], ties=True))
    least = F.struct(F.col("__id").isNull().alias("none"), "__id", *TIES, "__at")
    return only(own, rooted(rows, least).filter("__fp = root").select("component_id.__at"))

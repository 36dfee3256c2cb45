"""Literal crystals and molecules, and builders of supercells, vacancies and slabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STRUCTURES


def _fcc(a: float) -> list:
    return [[0.0, 0.0, 0.0], [0.0, a / 2, a / 2], [a / 2, 0.0, a / 2], [a / 2, a / 2, 0.0]]


def _cube(a: float) -> list:
    return [[a, 0.0, 0.0], [0.0, a, 0.0], [0.0, 0.0, a]]


def crystals() -> list[tuple]:
    """(name, charges, coords, cell, periodic)."""
    si = _fcc(5.43) + [[x + 5.43 / 4 for x in p] for p in _fcc(5.43)]
    nacl = _fcc(5.64) + [[p[0] + 2.82, p[1], p[2]] for p in _fcc(5.64)]
    water = [[10.0, 10.0, 10.1173], [10.0, 10.7572, 9.5308], [10.0, 9.2428, 9.5308]]
    d = 0.6276
    return [
        ("cu_fcc", [29.0] * 4, _fcc(3.615), _cube(3.615), True),
        ("fe_bcc", [26.0] * 2, [[0.0] * 3, [1.435] * 3], _cube(2.87), True),
        ("si_diamond", [14.0] * 8, si, _cube(5.43), True),
        ("nacl_rocksalt", [11.0] * 4 + [17.0] * 4, nacl, _cube(5.64), True),
        ("triclinic", [6.0, 8.0], [[0.1, 0.2, 0.3], [1.9, 1.1, 0.8]], [[3.0, 0.0, 0.0], [1.2, 3.1, 0.0], [0.7, 0.9, 3.3]], True),
        ("h2o_box", [8.0, 1.0, 1.0], water, _cube(20.0), False),
        ("ch4_box", [6.0, 1.0, 1.0, 1.0, 1.0], [[10.0] * 3, *[[10 + i * d, 10 + j * d, 10 + k * d] for i, j, k in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))]], _cube(20.0), False),
    ]


def structures(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The crystals as STRUCTURES; structure_id is the place in crystals()."""
    rows = [(i, c, p, cell, (t, t, t), None) for i, (name, c, p, cell, t) in enumerate(crystals()) if names is None or name in names]
    return spark.createDataFrame(rows, STRUCTURES)


def supercell(s: DataFrame, a: int, b: int, c: int) -> DataFrame:
    """Each structure repeated a x b x c times along its cell vectors."""
    ranges = [F.sequence(F.lit(0), F.lit(n - 1)) for n in (a, b, c)]
    shifts = F.flatten(F.transform(ranges[0], lambda i: F.flatten(F.transform(ranges[1], lambda j: F.transform(ranges[2], lambda k: F.array(i, j, k))))))
    moved = F.transform(shifts, lambda n: F.transform("coords", lambda p: F.array(*[p[x] + n[0] * F.col("cell")[0][x] + n[1] * F.col("cell")[1][x] + n[2] * F.col("cell")[2][x] for x in range(3)])))
    longer = F.array(*[F.lit(float(n)) for n in (a, b, c)])
    cell = F.zip_with("cell", longer, lambda v, n: F.transform(v, lambda x: x * n))
    return s.select("structure_id", F.flatten(F.array_repeat("charges", a * b * c)).alias("charges"), F.flatten(moved).alias("coords"), cell.alias("cell"), "pbc", "target")


def _times(v: list[int], m: list[list[int]]) -> list[int]:
    return [sum(v[r] * m[r][c] for r in range(3)) for c in range(3)]


def _adjugate(m: list[list[int]]) -> tuple[list[list[int]], int]:
    """(adjugate, determinant) of an integer matrix."""
    minor = lambda r, c: [m[(r + 1) % 3][(c + 1) % 3], m[(r + 1) % 3][(c + 2) % 3], m[(r + 2) % 3][(c + 1) % 3], m[(r + 2) % 3][(c + 2) % 3]]
    cofactor = [[(x := minor(r, c))[0] * x[3] - x[1] * x[2] for c in range(3)] for r in range(3)]
    return [[cofactor[c][r] for c in range(3)] for r in range(3)], sum(m[0][c] * cofactor[0][c] for c in range(3))


def hermite_normal_form(m: list[list[int]]) -> list[list[int]]:
    """The upper triangular matrix with a positive diagonal whose rows span the same lattice as m's."""
    h = [list(r) for r in m]
    for c in range(3):
        while sum(h[r][c] != 0 for r in range(c, 3)) > 1 or h[c][c] == 0:
            rest = [r for r in range(c, 3) if h[r][c] != 0]
            if not rest:
                raise ValueError("the matrix has no inverse")
            low = min(rest, key=lambda r: abs(h[r][c]))
            h[c], h[low] = h[low], h[c]
            for r in range(c + 1, 3):
                q = h[r][c] // h[c][c]
                h[r] = [x - q * y for x, y in zip(h[r], h[c], strict=True)]
        if h[c][c] < 0:
            h[c] = [-x for x in h[c]]
    return h


def cosets(m: list[list[int]]) -> list[list[int]]:
    """The |det m| lattice points in the cell spanned by m's rows: one of each coset, from the diagonal of the Hermite normal form, moved into the cell."""
    adjugate, det = _adjugate(m)
    h = hermite_normal_form(m)
    out = []
    for i in range(h[0][0]):
        for j in range(h[1][1]):
            for k in range(h[2][2]):
                n = [i, j, k]
                cells = [x // det for x in _times(n, adjugate)]
                out.append([x - y for x, y in zip(n, _times(cells, m), strict=True)])
    return sorted(out)


def _repeated(s: DataFrame, shifts: list[list[int]], m: list[list[int]]) -> DataFrame:
    """Each structure's atoms at every shift (in cell vectors), in the cell of the combinations m of its cell vectors."""
    along = lambda n, x: sum((F.lit(float(n[r])) * F.col("cell")[r][x] for r in range(3)), F.lit(0.0))
    steps = F.array(*[F.array(*[along(n, x) for x in range(3)]) for n in shifts])
    moved = F.flatten(F.transform(steps, lambda d: F.transform("coords", lambda p: F.zip_with(p, d, lambda a, b: a + b))))
    cell = F.array(*[F.array(*[along(r, x) for x in range(3)]) for r in m])
    return s.withColumn("charges", F.flatten(F.array_repeat("charges", len(shifts)))).withColumn("coords", moved).withColumn("cell", cell)


def matrix_supercell(s: DataFrame, m: list[list[int]]) -> DataFrame:
    """Each structure in the cell whose vectors are the integer combinations m (rows) of its own: |det m| copies of its atoms. Only fully periodic
    structures keep their neighbours."""
    return _repeated(s, cosets(m), m)


def plane_basis(hkl: tuple[int, int, int]) -> list[list[int]]:
    """Integer vectors of determinant 1: two in the lattice plane hkl, and one that leads to the next plane."""
    h, k, l = hkl  # noqa: E741

    def euclid(a: int, b: int) -> tuple[int, int, int]:
        """(g, x, y): x a + y b = g > 0, the greatest common divisor."""
        x, y, u, v = 1, 0, 0, 1
        while b:
            q = a // b
            a, b, x, y, u, v = b, a - q * b, u, v, x - q * u, y - q * v
        return (a, x, y) if a > 0 else (-a, -x, -y)

    if not any(hkl):
        raise ValueError("a plane has an index other than 0")
    if h == k == 0:
        out = [[1, 0, 0], [0, 1, 0], [0, 0, 1 if l > 0 else -1]]
    else:
        g, p, q = euclid(h, k)
        whole, r, t = euclid(g, l)
        out = [[k // g, -h // g, 0], [-p * l // whole, -q * l // whole, g // whole], [r * p, r * q, t]]
    if _adjugate(out)[1] < 0:
        out[0] = [-x for x in out[0]]
    return out


def miller_slab(s: DataFrame, hkl: tuple[int, int, int], layers: int, vacuum: float) -> DataFrame:
    """Each structure cut along the lattice plane hkl: layers copies of its cell, stacked across the plane, with vacuum above; the third cell vector stands upright on the plane
    and isn't periodic."""
    u = plane_basis(hkl)
    out = _repeated(s, [[k * x for x in u[2]] for k in range(layers)], u)
    a, b, c = (F.col("cell")[r] for r in range(3))
    across = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(sum((x * x for x in across), F.lit(0.0)))
    step = sum((x * c[k] for k, x in enumerate(across)), F.lit(0.0)) / size
    upright = F.array(*[x / size * (step * layers + vacuum) for x in across])
    return out.withColumn("cell", F.array(a, b, upright)).withColumn("pbc", F.struct(F.col("pbc.a").alias("a"), F.col("pbc.b").alias("b"), F.lit(False).alias("c")))


def vacancy(s: DataFrame, atom: int = 0) -> DataFrame:
    """Each structure without one of its atoms."""
    without = lambda c: F.filter(c, lambda _, i: i != atom)
    return s.withColumn("charges", without("charges")).withColumn("coords", without("coords"))


def slab(s: DataFrame, vacuum: float, axis: int = 2) -> DataFrame:
    """Each structure with room along an axis that is no longer periodic."""
    cell = F.transform("cell", lambda v, i: F.when(i == axis, F.transform(v, lambda x, k: F.when(k == axis, x + vacuum).otherwise(x))).otherwise(v))
    open_side = F.struct(*[(F.lit(False) if k == axis else F.col("pbc")[n]).alias(n) for k, n in enumerate("abc")])
    return s.withColumn("cell", cell).withColumn("pbc", open_side)

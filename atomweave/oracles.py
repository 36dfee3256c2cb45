"""The same queries as SQL for DuckDB over the same tables, written from the definitions and not from the operators."""

from __future__ import annotations

import math

from .operators.grids import VDW
from .sources.derived import waves

PI = repr(math.pi)


def R(x: str, digits: int = 6) -> str:
    return f"(CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END)"


def squeezed(x: str) -> str:
    return R(f"sign({x}) * ln(1 + abs({x}))", 5)


ATOMS = """atoms AS (
  SELECT l_orderkey AS structure_id,
         (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1)::INT AS atom_id,
         (1 + l_partkey % 92)::INT AS z, l_quantity - 10 * floor(l_quantity / 10) AS x, (l_partkey % 97) / 9.7::DOUBLE AS y, (l_suppkey % 89) / 8.9::DOUBLE AS zc
  FROM lineitem)"""


def pairs(rcut: float) -> str:
    return f"""{ATOMS}, apart AS (
  SELECT a.structure_id, a.atom_id AS i, b.atom_id AS j, a.z AS z_i, b.z AS z_j, b.x - a.x AS dx, b.y - a.y AS dy, b.zc - a.zc AS dz
  FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_id <> b.atom_id),
pairs AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM apart WHERE sqrt(dx * dx + dy * dy + dz * dz) > 0 AND sqrt(dx * dx + dy * dy + dz * dz) < {rcut})"""


ORDERED = "ordered AS (SELECT *, row_number() OVER (PARTITION BY structure_id, i ORDER BY j) AS o FROM pairs)"


def cut(r: str, rcut: float) -> str:
    return f"(0.5 * (cos({PI} * {r} / {rcut}::DOUBLE) + 1))"


def herm(m: int, x: str, a: float) -> str:
    u = f"({a!r}::DOUBLE * ({x}))"
    return ["1.0::DOUBLE", f"(-2 * {u})", f"(4 * {u} * {u} - 2 * {a!r}::DOUBLE)", f"(-8 * {u} * {u} * {u} + 12 * {u})", f"(16 * {u} * {u} * {u} * {u} - 48 * {u} * {u} + 12 * {a!r}::DOUBLE * {a!r}::DOUBLE)", f"(-32 * {u} * {u} * {u} * {u} * {u} + 160 * {u} * {u} * {u} - 120 * {u})"][m]


def weight(kind: str, a: float, x: str) -> str:
    return {"exp": f"exp(-{a}::DOUBLE * {x})", "power": f"(1 / (2.2508::DOUBLE * pow({x} + 1, {a}::DOUBLE)))", "cos": f"cos({a}::DOUBLE * {x})"}[kind]


def grid(name: str, domain: float, n: int, weights: list, width: float, scale: float, lag: int, orders: int = 2, sign: float = 1.0) -> str:
    """A table (channel, idx, value): the weights convolved with Gaussians times polynomials, each channel scaled to a largest absolute value of 1."""
    step = f"{domain / n!r}::DOUBLE"
    x = f"((i.v - k.v - {lag}) * {step})"
    parts = []
    for m in range(orders):
        for w, (kind, a) in enumerate(weights):
            f = f"exp(-{width!r}::DOUBLE * {x} * {x}) * {herm(m, x, scale)} * {sign if m else 1.0}::DOUBLE"
            parts.append(f"SELECT {m * len(weights) + w}::INT AS channel, i.v::INT AS idx, sum({weight(kind, a, f'(k.v * {step})')} * {f}) AS raw FROM range({n}) i(v), range({n}) k(v) GROUP BY i.v")
    return f"{name}_raw AS ({' UNION ALL '.join(parts)}), {name} AS (SELECT channel, idx, raw / max(abs(raw)) OVER (PARTITION BY channel) AS value FROM {name}_raw)"


RADIAL_W = [("exp", 1.5), ("exp", 5.0), ("power", 3.0), ("power", 5.0)]
COS = [("cos", 1.0), ("cos", 2.0)]
GRIDS = {
    "radial": grid("radial", 6.0, 120, RADIAL_W, 2.0, math.sqrt(2.0), 1, sign=2.0),
    "angular": grid("angular", math.pi, 64, COS, 2.0, math.sqrt(2.0), 1, sign=2.0),
    "solid": grid("solid", 2 * math.pi, 64, COS, 1.0, 1.0, 0),
    "plane": grid("plane", math.pi, 64, COS, 1.0, 1.0, 0),
    "legacy": grid("legacy", 6.0, 120, [("exp", 1.5), ("power", 2.0)], 6.0, 6.0, 1),
}


def cell(v: str, domain: float, n: int) -> str:
    return f"greatest(0, least(floor({v} / {domain / n!r}::DOUBLE + 1e-9), {n - 1}))::INT"


def summed(tuples: str, grid_name: str, weight_of: str = "w") -> str:
    """Sums by atom and channel over rows (structure_id, i, idx, w[, wc])."""
    return f"SELECT structure_id, i, channel, {squeezed('v')} AS value FROM (SELECT structure_id, i, channel::INT AS channel, sum({weight_of} * value) AS v FROM ({tuples}) JOIN {grid_name} USING (idx) GROUP BY ALL)"


THREE = """t AS (SELECT p.structure_id, p.i, p.z_i, p.j AS p, q.j AS q, p.z_j AS z_p, q.z_j AS z_q, p.r AS r_p, q.r AS r_q,
  p.dx AS px, p.dy AS py, p.dz AS pz, q.dx AS qx, q.dy AS qy, q.dz AS qz, q.dx - p.dx AS jx, q.dy - p.dy AS jy, q.dz - p.dz AS jz
  FROM ordered p JOIN ordered q ON p.structure_id = q.structure_id AND p.i = q.i AND p.o < q.o),
u AS (SELECT *, sqrt(jx * jx + jy * jy + jz * jz) AS r_pq FROM t WHERE sqrt(jx * jx + jy * jy + jz * jz) >= 1e-10),
triples AS (SELECT *, greatest(-1, least(1, (px * qx + py * qy + pz * qz) / (sqrt(px * px + py * py + pz * pz) * sqrt(qx * qx + qy * qy + qz * qz)))) AS cos1,
  greatest(-1, least(1, (px * jx + py * jy + pz * jz) / (r_p * r_pq))) AS cos2, greatest(-1, least(1, -(jx * qx + jy * qy + jz * qz) / (r_pq * r_q))) AS cos3 FROM u)"""

VEC = "v AS (SELECT vec_id AS id, label AS z, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), long AS (SELECT id, z, (unnest(range(1, 65)) - 1)::INT AS channel, unnest(f) AS value FROM v)"


def unit(a: str) -> str:
    return ", ".join(f"{a}{c} / sqrt({a}x * {a}x + {a}y * {a}y + {a}z * {a}z) AS {a}u{c}" for c in "xyz")


SQL: dict[str, str] = {}

SQL["atoms"] = f"WITH {ATOMS} SELECT structure_id, atom_id, z, {R('x')} AS x, {R('y')} AS y, {R('zc')} AS zc FROM atoms"
SQL["pair_join"] = f"WITH {pairs(6)} SELECT structure_id, i, j, z_i, z_j, {R('r')} AS r FROM pairs"
SQL["neighbor_ordinal"] = f"WITH {pairs(6)}, {ORDERED} SELECT structure_id, i, j, o::INT AS ordinal FROM ordered"
SQL["csr_offsets"] = f"""WITH {pairs(6)} SELECT structure_id, i, count(*) AS n,
  coalesce(sum(count(*)) OVER (PARTITION BY structure_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM pairs GROUP BY structure_id, i"""

_cheb = ["r / 6", "2 * pow(r / 6, 2) - 1", "4 * pow(r / 6, 3) - 3 * (r / 6)", "8 * pow(r / 6, 4) - 8 * pow(r / 6, 2) + 1", "16 * pow(r / 6, 5) - 20 * pow(r / 6, 3) + 5 * (r / 6)"]
_g2 = "((r * 1 + 2 * r * 1) / 2)"
SQL["scalar_functions"] = f"""WITH {pairs(4)}, g AS (SELECT *, {_g2} AS mu2, 0.5::DOUBLE AS s2, exp(-(r - 2 * r) * (r - 2 * r) / 2) AS zeta2 FROM pairs)
SELECT structure_id, i, j, {', '.join(f'{R(herm(d, "r", 0.5), 5)} AS hermite{d}' for d in range(1, 6))}, {', '.join(f'{R(c, 5)} AS chebyshev{k}' for k, c in enumerate(_cheb, 1))},
  {R(cut('r', 6), 5)} AS "cutoff", {R(f'-{PI} * sin({PI} * r / 6) / 12', 5)} AS slope, {R('sqrt(z_i::DOUBLE * z_j)', 5)} AS charge, {R('pow(r * r, 2)', 5)} AS damping, {R('exp(-0.5::DOUBLE * (r + r))', 5)} AS exponential,
  {R('exp(-2 * r * r / (1.5::DOUBLE * 1.5::DOUBLE))', 5)} AS basis, {R('(mu2 * 1 + 1 * s2) / (s2 + 1)', 5)} AS mu, {R('zeta2 * exp(-(mu2 - 1) * (mu2 - 1) / (s2 + 1))', 5)} AS zeta FROM g"""

SQL["periodic_pairs"] = f"""WITH {ATOMS}, p AS (
  SELECT a.structure_id, a.atom_id AS i, b.atom_id AS j, nx, ny, b.x - a.x + 10 * nx AS dx, b.y - a.y + 10 * ny AS dy, b.zc - a.zc AS dz
  FROM atoms a JOIN atoms b USING (structure_id), range(-2, 3) s(nx), range(-2, 3) t(ny)),
q AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p)
SELECT structure_id, i, count(*) AS n, {R('sum(r)', 5)} AS sum_r, sum(abs(nx) + abs(ny))::BIGINT AS moves FROM q
WHERE r > 1e-10 AND r < 4 AND NOT (i = j AND nx = 0 AND ny = 0) GROUP BY structure_id, i"""


_w2 = f"sqrt(z_i::DOUBLE * z_j) * {cut('r', 6)}"
SQL["two_body_sum"] = f"WITH {pairs(6)}, {GRIDS['radial']} {summed(f'SELECT structure_id, i, {cell("r", 6.0, 120)} AS idx, {_w2} AS w FROM pairs', 'radial')}"
SQL["two_body_plain"] = f"WITH {pairs(6)}, {GRIDS['radial']} {summed(f'SELECT structure_id, i, {cell("r", 6.0, 120)} AS idx, sqrt(z_i::DOUBLE * z_j) AS w FROM pairs', 'radial')}"
_idx = cell("r", 6.0, 120)
_frac = f"greatest(0, least(1, r / {6.0 / 120!r}::DOUBLE - {_idx}))"
SQL["two_body_linear"] = f"WITH {pairs(6)}, {GRIDS['radial']} " + summed(f"SELECT structure_id, i, {_idx} AS idx, {_w2} * (1 - {_frac}) AS w FROM pairs UNION ALL SELECT structure_id, i, least({_idx} + 1, 119) AS idx, {_w2} * {_frac} AS w FROM pairs", "radial")

_radii = sorted({1.0, *VDW.values()})
_x = "((i.v - k.v - 1) * 0.1::DOUBLE)"
_element_parts = [f"SELECT cls, {2 * m + w}::INT AS channel, i.v::INT AS idx, sum({weight(kind, e, '(k.v * 0.1::DOUBLE)')} * exp(-radius * radius * {_x} * {_x}) * {('1', f'(-2 * radius * radius * {_x})')[m]}) AS raw FROM classes, range(60) i(v), range(60) k(v) GROUP BY cls, i.v" for m in range(2) for w, (kind, e) in enumerate(RADIAL_W[:2])]
_class = "CASE z_j " + " ".join(f"WHEN {z} THEN {_radii.index(r)}" for z, r in VDW.items()) + f" ELSE {_radii.index(1.0)} END"
SQL["two_body_element"] = f"""WITH {pairs(6)}, classes AS (SELECT * FROM (VALUES {', '.join(f'({k}, {r!r}::DOUBLE)' for k, r in enumerate(_radii))}) c(cls, radius)), parts AS ({' UNION ALL '.join(_element_parts)}),
every AS (SELECT cls, channel, idx, raw / max(abs(raw)) OVER (PARTITION BY cls, channel) AS value FROM parts),
s AS (SELECT structure_id, i, channel::INT AS channel, sum(w * value) AS v FROM (SELECT structure_id, i, {cell('r', 6.0, 60)} AS idx, {_class} AS cls, {_w2} AS w FROM pairs) JOIN every USING (idx, cls) GROUP BY ALL)
SELECT structure_id, i, channel, {squeezed('v')} AS value FROM s"""

SQL["triple_join"] = f"WITH {pairs(6)}, {ORDERED}, {THREE} SELECT structure_id, i, p, q, {R('r_pq')} AS r, {R('cos1', 5)} AS cos1, {R('cos2', 5)} AS cos2, {R('cos3', 5)} AS cos3 FROM triples"


def _three(rows: str, c: tuple, r: tuple, z: tuple, factor: str) -> str:
    w = f"{factor} * pow({z[0]}::DOUBLE * {z[1]} * {z[2]}, {1 / 3!r}::DOUBLE) / pow({r[0]} * {r[1]} * {r[2]}, 2)"
    t = f"SELECT structure_id, i, {cell(f'acos({c[0]})', math.pi, 64)} AS idx, {w} AS w, {w} * {c[1]} * {c[2]} AS wc FROM {rows}"
    return summed(t, "angular", "(CASE WHEN channel % 2 = 0 THEN wc ELSE w END)")


_f3 = f"2 * {cut('r_p', 6)} * {cut('r_q', 6)} * (CASE WHEN r_pq < 6 THEN {cut('r_pq', 6)} ELSE 0 END)"
SQL["three_body_sum"] = f"WITH {pairs(6)}, {ORDERED}, {THREE}, {GRIDS['angular']} " + _three("triples", ("cos1", "cos2", "cos3"), ("r_p", "r_q", "r_pq"), ("z_i", "z_p", "z_q"), _f3)

_mol = f"""{ATOMS}, m AS (SELECT a.structure_id, a.atom_id AS ia, b.atom_id AS ib, c.atom_id AS ic, a.z AS za, b.z AS zb, c.z AS z_c,
  b.x - a.x AS px, b.y - a.y AS py, b.zc - a.zc AS pz, c.x - a.x AS qx, c.y - a.y AS qy, c.zc - a.zc AS qz, c.x - b.x AS jx, c.y - b.y AS jy, c.zc - b.zc AS jz
  FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_id < b.atom_id JOIN atoms c ON a.structure_id = c.structure_id AND b.atom_id < c.atom_id),
n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS rab, sqrt(qx * qx + qy * qy + qz * qz) AS rac, sqrt(jx * jx + jy * jy + jz * jz) AS rbc FROM m),
o AS (SELECT *, greatest(-1, least(1, (px * qx + py * qy + pz * qz) / (rab * rac))) AS ca, greatest(-1, least(1, -(px * jx + py * jy + pz * jz) / (rab * rbc))) AS cb,
  greatest(-1, least(1, (qx * jx + qy * jy + qz * jz) / (rac * rbc))) AS cc FROM n WHERE rab > 0 AND rab < 4 AND rac > 0 AND rac < 4 AND rbc > 0),
mol AS (SELECT structure_id, ia AS i, za AS z1, zb AS z2, z_c AS z3, rab AS r1, rac AS r2, rbc AS r3, ca AS c1, cb AS c2, cc AS c3 FROM o
  UNION ALL SELECT structure_id, ib, zb, za, z_c, rab, rbc, rac, cb, ca, cc FROM o UNION ALL SELECT structure_id, ic, z_c, za, zb, rac, rbc, rab, cc, ca, cb FROM o)"""
SQL["molecular_three_body"] = f"WITH {_mol}, {GRIDS['angular']} " + _three("mol", ("c1", "c2", "c3"), ("r1", "r2", "r3"), ("z1", "z2", "z3"), "2")

_legs = lambda names: ", ".join(f"{n}.dx AS {n}x, {n}.dy AS {n}y, {n}.dz AS {n}z, {n}.r AS r_{n}, {n}.z_j AS z_{n}" for n in names)
_join = lambda names: "ordered p " + " ".join(f"JOIN ordered {b} ON p.structure_id = {b}.structure_id AND p.i = {b}.i AND {a}.o < {b}.o" for a, b in zip(names, names[1:], strict=False))
_uu = lambda a, b: f"({a}ux * {b}ux + {a}uy * {b}uy + {a}uz * {b}uz)"
_omega = f"(2 * atan2(abs(pux * (quy * suz - quz * suy) + puy * (quz * sux - qux * suz) + puz * (qux * suy - quy * sux)), greatest(1 + {_uu('p', 'q')} + {_uu('p', 's')} + {_uu('q', 's')}, 1e-10)))"
_w4 = f"sqrt(sqrt(z_i::DOUBLE * z_p * z_q * z_s)) * {cut('r_p', 4)} * {cut('r_q', 4)} * {cut('r_s', 4)} / (r_p * r_q * r_s)"
SQL["quad_solid_angle"] = f"""WITH {pairs(4)}, {ORDERED}, {GRIDS['solid']}, t AS (SELECT p.structure_id, p.i, p.z_i, {_legs('pqs')} FROM {_join('pqs')}),
u AS (SELECT *, {unit('p')}, {unit('q')}, {unit('s')} FROM t) {summed(f'SELECT structure_id, i, {cell(_omega, 2 * math.pi, 64)} AS idx, {_w4} AS w FROM u', 'solid')}"""


def _psi(a: str, b: str, c: str, m: str) -> str:
    d = lambda p, q, k: f"({p}{k} - {q}{k})"
    n = [f"({d(b, a, 'y')} * {d(c, a, 'z')} - {d(b, a, 'z')} * {d(c, a, 'y')})", f"({d(b, a, 'z')} * {d(c, a, 'x')} - {d(b, a, 'x')} * {d(c, a, 'z')})", f"({d(b, a, 'x')} * {d(c, a, 'y')} - {d(b, a, 'y')} * {d(c, a, 'x')})"]
    size = f"(sqrt({m}x * {m}x + {m}y * {m}y + {m}z * {m}z) * sqrt({' + '.join(f'{v} * {v}' for v in n)}))"
    return f"(CASE WHEN {size} < 1e-10 THEN 0 ELSE acos(least(1, abs({m}x * {n[0]} + {m}y * {n[1]} + {m}z * {n[2]}) / (CASE WHEN {size} = 0 THEN 1 ELSE {size} END))) END)"


_fifth = f"pow(z_i::DOUBLE * z_p * z_q * z_s * z_t, 0.2::DOUBLE) * {cut('r_p', 4)} * {cut('r_q', 4)} * {cut('r_s', 4)} * {cut('r_t', 4)} / (r_p * r_q * r_s * r_t)"
_psis = " UNION ALL ".join(f"SELECT structure_id, i, {cell(_psi(*[n for n in 'pqst' if n != m], m), math.pi, 64)} AS idx, {_fifth} AS w FROM t" for m in "pqst")
SQL["quint_out_of_plane"] = f"WITH {pairs(4)}, {ORDERED}, {GRIDS['plane']}, t AS (SELECT p.structure_id, p.i, p.z_i, {_legs('pqst')} FROM {_join('pqst')}) {summed(_psis, 'plane')}"

_fold = "legacy0 AS (SELECT *, r_p AS mu0, 1.0::DOUBLE AS s0, 1.0::DOUBLE AS e0 FROM l)"
for _k, _r in enumerate(("r_q", "r_s", "r_pq", "r_ps", "r_qs")):
    _fold += f", legacy{_k + 1} AS (SELECT *, (mu{_k} * 1 + {_r} * s{_k}) / (s{_k} + 1) AS mu{_k + 1}, s{_k} / (s{_k} + 1) AS s{_k + 1}, e{_k} * exp(-((mu{_k} - {_r}) * (mu{_k} - {_r})) / (s{_k} + 1)) AS e{_k + 1} FROM legacy{_k})"
_all_legs = "ordered p JOIN ordered q ON p.structure_id = q.structure_id AND p.i = q.i JOIN ordered s ON p.structure_id = s.structure_id AND p.i = s.i"
_gaps = ", ".join(f"sqrt(({a}.dx - {b}.dx) * ({a}.dx - {b}.dx) + ({a}.dy - {b}.dy) * ({a}.dy - {b}.dy) + ({a}.dz - {b}.dz) * ({a}.dz - {b}.dz)) AS r_{a}{b}" for a, b in ("pq", "ps", "qs"))
SQL["legacy_four_body"] = f"""WITH {pairs(3)}, {ORDERED}, {GRIDS['legacy']}, l AS (SELECT p.structure_id, p.i, p.z_i, {_legs('pqs')}, {_gaps} FROM {_all_legs}), {_fold}
{summed(f"SELECT structure_id, i, greatest(0, least(round_even(mu5 / {6.0 / 120!r}::DOUBLE, 0), 119))::INT AS idx, sqrt(sqrt(z_i::DOUBLE * z_p * z_q * z_s)) * e5 / pow(r_p * r_q * r_s, 2) AS w FROM legacy5", 'legacy')}"""

SQL["grid_convolutions"] = f"WITH {', '.join(GRIDS.values())} " + " UNION ALL ".join(f"SELECT '{n}' AS grid, channel, idx, {R('value')} AS value FROM {n}" for n in GRIDS)
SQL["grid_gradient"] = f"""WITH {GRIDS['radial']}, b AS (SELECT channel, idx, value, lag(value) OVER w AS a, lead(value) OVER w AS c FROM radial WINDOW w AS (PARTITION BY channel ORDER BY idx))
SELECT channel, idx, {R('CASE WHEN a IS NULL THEN (c - value) / 0.05::DOUBLE WHEN c IS NULL THEN (value - a) / 0.05::DOUBLE ELSE (c - a) / 0.1::DOUBLE END', 5)} AS slope FROM b"""

SQL["global_pool"] = f"WITH {VEC} SELECT z, channel, {R('sum(value)', 5)} AS value FROM long GROUP BY z, channel"
SQL["element_norm_factors"] = f"WITH {VEC}, f AS (SELECT z, channel, avg(abs(value)) AS a, max(abs(value)) AS m FROM long GROUP BY z, channel) SELECT z, channel, {R('CASE WHEN a = 0 THEN 1 ELSE a END')} AS factor, {R('CASE WHEN m = 0 THEN 1 ELSE m END')} AS largest FROM f"
SQL["element_norm_apply"] = f"""WITH {VEC}, f AS (SELECT z, channel, CASE WHEN avg(abs(value)) = 0 THEN 1 ELSE avg(abs(value)) END AS a FROM long WHERE id % 2 = 0 AND z <> 3 GROUP BY z, channel)
SELECT id, long.channel, {R('value / coalesce(a, 1)')} AS value FROM long LEFT JOIN f ON long.z = f.z AND long.channel = f.channel"""
SQL["bag_sort"] = f"""WITH {ATOMS}, a AS (SELECT structure_id, z % 5 + 1 AS z, x, y, zc FROM atoms), r AS (SELECT structure_id, z, 0 AS channel, x AS value FROM a UNION ALL SELECT structure_id, z, 1, y FROM a UNION ALL SELECT structure_id, z, 2, zc FROM a),
sizes AS (SELECT z, max(n) AS size FROM (SELECT structure_id, z, count(*) AS n FROM a GROUP BY ALL) GROUP BY z), slots AS (SELECT z, unnest(range(1, size + 1))::INT AS slot FROM sizes),
k AS (SELECT *, row_number() OVER (PARTITION BY structure_id, z, channel ORDER BY value DESC) AS slot FROM r)
SELECT s.structure_id, c.channel, slots.z, slots.slot, {R('coalesce(k.value, 0)')} AS value FROM (SELECT DISTINCT structure_id FROM a) s, range(0, 3) q(channel), slots, (SELECT 1) one, LATERAL (SELECT q.channel::INT AS channel) c
LEFT JOIN k ON k.structure_id = s.structure_id AND k.z = slots.z AND k.channel = c.channel AND k.slot = slots.slot"""

SQL["composition_filter"] = f"WITH {ATOMS} SELECT structure_id, count(*)::INT AS n_atoms, count(DISTINCT z)::INT AS n_species FROM atoms GROUP BY structure_id HAVING count(DISTINCT z) BETWEEN 2 AND 5 AND max(z) <= 83 AND count(*) <= 6"
SQL["size_bins"] = f"""WITH {ATOMS}, n AS (SELECT count(*) AS n FROM atoms GROUP BY structure_id), b AS (SELECT n, CASE WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' WHEN n <= 8 THEN '5-8' WHEN n <= 12 THEN '9-12' END AS bin FROM n)
SELECT bin, count(*) AS n, sum(n)::BIGINT AS atoms FROM b WHERE bin IS NOT NULL GROUP BY bin"""
SQL["atomization_target"] = f"WITH {ATOMS}, s AS (SELECT structure_id, sum(CASE WHEN z < 60 THEN -0.5::DOUBLE * z * z ELSE 0 END) AS e FROM atoms GROUP BY structure_id) SELECT structure_id, {R('-(o_totalprice - e) * 627.509::DOUBLE', 3)} AS energy FROM orders JOIN s ON o_orderkey = structure_id"
SQL["centered_target"] = f"SELECT o_orderkey AS structure_id, {R('o_totalprice - avg(o_totalprice) OVER ()', 3)} AS target FROM orders"
_key = lambda seed: f"(((o_orderkey % 2147483648 * 2654435761) % 4294967296 * {2 * seed + 1} + {seed}) % 4294967296)"
_ranked = lambda seed: f"SELECT o_orderkey AS structure_id, row_number() OVER (ORDER BY {_key(seed)}, o_orderkey) AS rank, count(*) OVER () AS n FROM orders"
SQL["random_sample"] = f"SELECT o_orderkey AS structure_id FROM orders ORDER BY {_key(42)}, o_orderkey LIMIT 500"
SQL["train_test_split"] = f"SELECT structure_id, CASE WHEN rank <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM ({_ranked(42)})"
SQL["kfold_assign"] = f"SELECT o_orderkey AS structure_id, ntile(5) OVER (ORDER BY {_key(18012019)}, o_orderkey)::INT AS fold FROM orders"
SQL["learning_curve_prefix"] = f"SELECT size::INT AS size, count(*) AS n, sum(structure_id)::BIGINT AS ids FROM ({_ranked(42)}), (VALUES (100), (500), (1000), (1000000000)) s(size) WHERE rank <= size AND size <= n GROUP BY size"
SQL["set_difference"] = f"""WITH {ATOMS} SELECT 'in' AS part, count(DISTINCT z) AS elements, sum(DISTINCT z)::BIGINT AS sum_z FROM atoms WHERE structure_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
UNION ALL SELECT 'out', count(DISTINCT z), sum(DISTINCT z)::BIGINT FROM atoms WHERE structure_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"""
SQL["standardize"] = f"WITH {VEC}, f AS (SELECT channel, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM long WHERE id % 5 > 0 GROUP BY channel) SELECT id, channel, {R('(value - m) / s', 5)} AS value FROM long JOIN f USING (channel) WHERE id % 5 = 0"
_corr = lambda n: f"c AS (SELECT p.channel AS a, q.channel AS b, corr(p.value, q.value) AS r FROM long p JOIN long q ON p.id = q.id AND p.channel < q.channel AND q.channel < {n} GROUP BY ALL)"
SQL["feature_corr"] = f"WITH {VEC}, {_corr(64)} SELECT a, b, {R('r')} AS r FROM c"
SQL["feature_corr_counts"] = f"WITH {VEC}, {_corr(64)} SELECT level::DOUBLE AS level, count(*) FILTER (abs(r) > level) AS n FROM c, (VALUES (0.2::DOUBLE), (0.1::DOUBLE), (0.05::DOUBLE)) l(level) GROUP BY level"
_var = "s AS (SELECT channel, var_pop(value) AS variance FROM long GROUP BY channel), k AS (SELECT *, row_number() OVER (ORDER BY abs(variance) DESC, channel)::INT AS rank FROM s)"
SQL["feature_variance"] = f"WITH {VEC}, {_var} SELECT channel, {R('variance')} AS variance, variance < 1e-6 AS constant, rank FROM k"
SQL["top_feature_sets"] = f"WITH {VEC}, {_var} SELECT size::INT AS size, channel FROM k, (VALUES (5), (10), (35)) n(size) WHERE rank <= size"
_lab = "lab AS (SELECT c::INT AS channel, CASE WHEN c < 20 THEN 'radial' ELSE 'angular' END AS block, ((c % 20) // 4)::INT AS m, (c % 4)::INT AS weight FROM range(40) r(c))"
SQL["feature_importance"] = f"WITH {VEC}, {_lab}, {_var} SELECT block, m, {R('avg(variance)')} AS mean FROM s JOIN lab USING (channel) GROUP BY GROUPING SETS ((block), (block, m))"
SQL["feature_labels"] = f"WITH {_lab} SELECT channel, block, m, weight, printf('%s m=%d w=%d', block, m, weight) AS label FROM lab"
_keep = [m * 4 + w for m in range(3) for w in range(4)] + [20 + m * 4 + w for m in range(5) for w in (0, 2, 3)]
SQL["feature_subset"] = f"WITH {VEC}, k AS (SELECT * FROM (VALUES {', '.join(f'({c}, {i + 1})' for i, c in enumerate(_keep))}) t(channel, place)) SELECT id, count(*) AS n, {R('sum(value * place)', 5)} AS checksum FROM long JOIN k USING (channel) GROUP BY id"

_each = lambda e: f"list_sum(list_transform(range(1, 65), lambda k: {e}))"
_l1, _l2 = _each("abs(a.f[k] - b.f[k])"), _each("(a.f[k] - b.f[k]) * (a.f[k] - b.f[k])")
SQL["laplacian_kernel"] = f"WITH {VEC}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_l1} AS l1 FROM v a JOIN v b ON b.id % 50 = 0) SELECT a_id, b_id, {R('exp(-0.05::DOUBLE * l1)')} AS k FROM p"
SQL["symmetric_kernel"] = f"WITH {VEC}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_l1} AS l1 FROM v a CROSS JOIN v b) SELECT a_id, b_id, {R('exp(-0.02::DOUBLE * l1)')} AS k FROM p"
SQL["polynomial_rbf_kernels"] = f"""WITH {VEC}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_each('a.f[k] * b.f[k]')} AS d, {_l2} AS l2 FROM v a JOIN v b ON b.id % 50 = 0)
SELECT a_id, b_id, {R('pow(d / 64 + 1, 3)', 5)} AS poly, {R('exp(-0.1::DOUBLE * l2)')} AS rbf FROM p"""
_near = lambda e: f"k AS (SELECT a.id // 8 AS a_id, b.id // 8 AS b_id, (a.id % 8)::INT AS a_atom, (b.id % 8)::INT AS b_atom, {e} AS c FROM v a JOIN v b ON a.z = b.z AND (b.id // 8) % 50 = 0)"
SQL["delta_kernel"] = f"WITH {VEC}, {_near(f'exp(-{_l1} / 16)')} SELECT a_id, b_id, {R('sum(c)')} AS k FROM k GROUP BY a_id, b_id"
SQL["local_kernel_l2"] = f"WITH {VEC}, {_near(f'exp(-sqrt({_l2}) / 4)')} SELECT a_id, b_id, a_atom, b_atom, {R('c')} AS c FROM k"
_f = "list_transform(range(1, na + 1), lambda i: -ln(na) - ln(list_sum(list_transform(range(1, nb + 1), lambda j: exp(gain[i][j] + g[j])))))"
_g = "list_transform(range(1, nb + 1), lambda j: -ln(nb) - ln(list_sum(list_transform(range(1, na + 1), lambda i: exp(gain[i][j] + f[i])))))"
SQL["best_match_kernel"] = f"""WITH RECURSIVE {VEC}, m AS (SELECT id // 8 AS s, list(z ORDER BY id) AS z, list(f ORDER BY id) AS f FROM v GROUP BY 1),
c AS (SELECT a.s AS a_id, b.s AS b_id, len(a.z) AS na, len(b.z) AS nb, list_transform(range(1, len(a.z) + 1), lambda i: list_transform(range(1, len(b.z) + 1), lambda j:
  CASE WHEN a.z[i] = b.z[j] THEN exp(-list_sum(list_transform(range(1, 65), lambda k: abs(a.f[i][k] - b.f[j][k]))) / 16) ELSE 0.0::DOUBLE END)) AS c FROM m a JOIN m b ON b.s % 50 = 0),
steps AS (SELECT a_id, b_id, na, nb, c, list_transform(c, lambda x: list_transform(x, lambda y: ln(y + 1e-16) / 0.5)) AS gain, 0 AS n, list_transform(range(0, na), lambda x: 0.0::DOUBLE) AS f, list_transform(range(0, nb), lambda x: 0.0::DOUBLE) AS g FROM c
  UNION ALL SELECT a_id, b_id, na, nb, c, gain, n + 1, CASE WHEN n % 2 = 0 THEN {_f} ELSE f END, CASE WHEN n % 2 = 1 THEN {_g} ELSE g END FROM steps WHERE n < 120)
SELECT a_id, b_id, {R('list_sum(list_transform(range(1, na + 1), lambda i: list_sum(list_transform(range(1, nb + 1), lambda j: exp(gain[i][j] + f[i] + g[j]) * c[i][j]))))', 5)} AS k FROM steps WHERE n = 120"""

_err = "e AS (SELECT l_orderkey % 5 AS fold, gamma, alpha, avg(abs(l_extendedprice - (l_quantity * gamma + alpha))) AS mae FROM lineitem, (VALUES (800.0::DOUBLE), (1000.0::DOUBLE), (1200.0::DOUBLE)) g(gamma), (VALUES (0.0::DOUBLE), (5000.0::DOUBLE)) a(alpha) GROUP BY ALL)"
SQL["fold_errors"] = f"WITH {_err} SELECT gamma, alpha, {R('avg(mae)', 3)} AS mean, {R('stddev_pop(mae)', 3)} AS sd FROM e GROUP BY gamma, alpha"
SQL["grid_argmin"] = f"WITH {_err} SELECT fold, gamma, alpha, {R('mae', 3)} AS mae FROM e QUALIFY row_number() OVER (PARTITION BY fold ORDER BY e.mae, gamma, alpha) = 1"
_year = "y AS (SELECT year(o_orderdate)::INT AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1)"
SQL["percent_change"] = f"WITH {_year}, c AS (SELECT year, 100 * (value - lag(value) OVER (ORDER BY year)) / lag(value) OVER (ORDER BY year) AS c FROM y) SELECT year, {R('c', 5)} AS change FROM c"
SQL["relative_improvement"] = f"WITH {_year}, c AS (SELECT year, 100 * (first_value(value) OVER (ORDER BY year) - value) / first_value(value) OVER (ORDER BY year) AS c FROM y) SELECT year, {R('c', 5)} AS improvement FROM c"
SQL["log_extrapolation"] = f"""WITH s AS (SELECT o_orderkey % 7 + 1 AS k, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1), c AS (SELECT ln((k * 1000)::DOUBLE) AS x, ln(s / sqrt(k::DOUBLE)) AS y, row_number() OVER (ORDER BY k DESC) AS pos FROM s),
d AS (SELECT max(x) FILTER (pos = 1) AS x, max(y) FILTER (pos = 1) AS y, max(x) FILTER (pos = 3) AS x0, max(y) FILTER (pos = 3) AS y0 FROM c)
SELECT {R('(y - y0) / (x - x0)')} AS slope, {R('exp(x + (ln(1000::DOUBLE) - y) / ((y - y0) / (x - x0)))', 1)} AS n_goal FROM d"""
SQL["describe_targets"] = f"""WITH {ATOMS}, s AS (SELECT count(*) AS n, structure_id FROM atoms GROUP BY structure_id), j AS (SELECT n AS k, o_totalprice AS t FROM s JOIN orders ON o_orderkey = structure_id)
SELECT count(*) AS n, min(k)::INT AS min_atoms, max(k)::INT AS max_atoms, {R('avg(k)')} AS mean_atoms, {R('min(t)', 2)} AS min_target, {R('max(t)', 2)} AS max_target, {R('avg(t)', 2)} AS mean_target FROM j"""
SQL["median_by_priority"] = f"SELECT o_orderpriority, {R('median(o_totalprice)', 3)} AS median FROM orders GROUP BY o_orderpriority"
SQL["component_errors"] = f"WITH {ATOMS} SELECT z, {R('avg(abs(y - zc))', 5)} AS mae, {R('corr(y, zc)', 5)} AS r FROM atoms GROUP BY z"
_site = "d AS (SELECT z, sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5) + (zc - 5) * (zc - 5)) AS r FROM atoms)"
SQL["site_distance"] = f"WITH {ATOMS}, {_site} SELECT z, CASE WHEN r < 3 THEN 'near' WHEN r > 5 THEN 'far' ELSE 'between' END AS zone, count(*) AS n, {R('sum(r)', 4)} AS sum_r FROM d GROUP BY ALL"
SQL["nearest_layer"] = f"WITH {ATOMS} SELECT structure_id, atom_id, k::INT AS layer_id, {R('abs(1 + 2.5::DOUBLE * k - zc)', 5)} AS gap FROM atoms, range(4) l(k) QUALIFY row_number() OVER (PARTITION BY structure_id, atom_id ORDER BY abs(1 + 2.5::DOUBLE * k - zc), k) = 1"
SQL["layer_means"] = f"WITH {VEC}, m AS (SELECT z, id % 3 AS layer, channel, avg(value) AS v FROM long GROUP BY ALL) SELECT z, layer, {R('sqrt(sum(v * v))', 5)} AS norm FROM m GROUP BY z, layer"
SQL["group_spread"] = f"WITH {VEC} SELECT z, channel, {R('max(value) - min(value)')} AS spread FROM long GROUP BY z, channel"
SQL["cross_run_difference"] = "SELECT 0::BIGINT AS unmatched, 0.0::DOUBLE AS difference"
SQL["message_step"] = f"""WITH {pairs(4)}, m AS (SELECT p.structure_id, p.j AS atom_id, sum(a.z * {cut('p.r', 4)}) AS m0, sum(a.x * {cut('p.r', 4)}) AS m1 FROM pairs p JOIN atoms a ON a.structure_id = p.structure_id AND a.atom_id = p.i GROUP BY ALL)
SELECT a.structure_id, a.atom_id, {R('a.z + coalesce(m0, 0)', 4)} AS f0, {R('a.x + coalesce(m1, 0)', 4)} AS f1 FROM atoms a LEFT JOIN m USING (structure_id, atom_id)"""
SQL["xyz_parse"] = f"""SELECT o_orderkey, {R('CASE WHEN o_orderkey % 5 = 0 THEN round(o_orderkey / 8, 3) / 10 ELSE (o_orderkey % 1000)::DOUBLE END', 4)} AS energy, 15.0::DOUBLE AS charge,
  ((o_orderkey % 11) + (o_orderkey % 16) * 100 + (o_orderkey % 24) * 10000)::DOUBLE AS checksum FROM orders WHERE o_orderkey % 7 <> 0"""
SQL["stream_norm_factors"] = f"WITH {VEC}, f AS (SELECT z, channel, avg(abs(value)) AS a FROM long GROUP BY z, channel) SELECT z, channel, {R('CASE WHEN a = 0 THEN 1 ELSE a END')} AS factor FROM f"
SQL["two_body_gradient"] = f"""WITH {pairs(4)}, {GRIDS['radial']}, b AS (SELECT channel, idx, value, lag(value) OVER w AS a, lead(value) OVER w AS c FROM radial WINDOW w AS (PARTITION BY channel ORDER BY idx)),
d AS (SELECT channel, idx, value, CASE WHEN a IS NULL THEN (c - value) / 0.05::DOUBLE WHEN c IS NULL THEN (value - a) / 0.05::DOUBLE ELSE (c - a) / 0.1::DOUBLE END AS slope FROM b),
q AS (SELECT *, {cell('r', 6.0, 120)} AS idx FROM pairs),
e AS (SELECT structure_id, i, channel, dx, dy, dz, sqrt(z_i::DOUBLE * z_j) * (-{PI} * sin({PI} * r / 6) / 12 * value + {cut('r', 6)} * slope) / r AS k FROM q JOIN d USING (idx))
SELECT structure_id, i, channel, {squeezed('-sum(k * dx)')} AS gx, {squeezed('-sum(k * dy)')} AS gy, {squeezed('-sum(k * dz)')} AS gz FROM e GROUP BY structure_id, i, channel"""
_step = lambda n, h: f"{n} AS (SELECT a.structure_id, a.atom_id, a.f0 + coalesce(sum(b.f0 * {cut('p.r', 4)}), 0) AS f0, a.f1 + coalesce(sum(b.f1 * {cut('p.r', 4)}), 0) AS f1 FROM {h} a LEFT JOIN pairs p ON p.structure_id = a.structure_id AND p.j = a.atom_id LEFT JOIN {h} b ON b.structure_id = p.structure_id AND b.atom_id = p.i GROUP BY a.structure_id, a.atom_id, a.f0, a.f1)"
SQL["message_network"] = f"WITH {pairs(4)}, h0 AS (SELECT structure_id, atom_id, z::DOUBLE AS f0, x AS f1 FROM atoms), {_step('h1', 'h0')}, {_step('h2', 'h1')} SELECT structure_id, {R('sum(0.5::DOUBLE * f0 + 2 * f1)', 3)} AS p FROM h2 GROUP BY structure_id"
SQL["feature_blocks"] = f"""WITH {VEC}, k AS (SELECT id, channel, CASE WHEN value > 0.1::DOUBLE THEN value ELSE 0 END AS value FROM long WHERE channel < 4), keep AS (SELECT id FROM k GROUP BY id HAVING max(abs(value)) > 0),
b AS (SELECT id, channel AS place, value FROM k UNION ALL SELECT id, channel - 6, value FROM long WHERE channel BETWEEN 10 AND 15) SELECT id, 40::BIGINT AS n, {R('sum(value * (place + 1))', 5)} AS checksum FROM b JOIN keep USING (id) GROUP BY id"""
SQL["boxed_molecules"] = f"WITH {pairs(4)} SELECT structure_id, count(*) AS n, {R('sum(r)', 4)} AS sum_r FROM pairs WHERE r > 1e-10 GROUP BY structure_id"

# forces of the pair energy, by its slope instead of by differences
SQL["force_field"] = f"""WITH {pairs(6)}, f AS (SELECT structure_id, i, {', '.join(f"sum(-{PI} * sin({PI} * r / 6) / 6 * d{c} / r) AS f{c}" for c in 'xyz')} FROM pairs GROUP BY structure_id, i),
a AS (SELECT atoms.structure_id, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, coalesce(fz, 0) AS fz FROM atoms LEFT JOIN f ON f.structure_id = atoms.structure_id AND f.i = atoms.atom_id),
u AS (SELECT structure_id, 0 AS axis, fx AS f FROM a UNION ALL SELECT structure_id, 1, fy FROM a UNION ALL SELECT structure_id, 2, fz FROM a)
SELECT structure_id, axis::INT AS axis, count(*) AS n, {R('sum(f)', 3)} AS total, {R('sum(abs(f))', 3)} AS size FROM u GROUP BY structure_id, axis"""

# whole plans, on the grids of their own steps
_minus = -math.sqrt(2.0)
COS4, COS3 = [("cos", float(k)) for k in range(1, 5)], [("cos", float(k)) for k in range(1, 4)]


def plan_grid(kind: str, rcut: float, n: int, orders: int) -> str:
    return {
        "radial": lambda: grid("radial", rcut, n, RADIAL_W, 2.0, math.sqrt(2.0), 1, orders, _minus**orders),
        "angular": lambda: grid("angular", math.pi, n, COS4, 2.0, math.sqrt(2.0), 1, orders, _minus**orders),
        "solid": lambda: grid("solid", 2 * math.pi, n, COS4, 1.0, 1.0, 0, orders, (-1.0) ** orders),
        "plane": lambda: grid("plane", math.pi, n, COS3, 1.0, 1.0, 0, orders, (-1.0) ** orders),
        "legacy": lambda: grid("legacy", rcut, n, [("exp", 1.5), ("exp", 3.0), ("exp", 4.5), ("power", 2.0), ("power", 3.0)], 6.0, 6.0, 1, orders),
    }[kind]()


def near_cell(v: str, domain: float, n: int) -> str:
    return f"greatest(0, least(round_even({v} / {domain / n!r}::DOUBLE, 0), {n - 1}))::INT"


def image_pairs(rcut: float, reach: int) -> str:
    """pairs and ordered of sites and cells over periodic images."""
    cells = f"range(-{reach}, {reach + 1})"
    return f"""moved AS (SELECT a.structure_id, a.i, b.i AS j, a.z AS z_i, b.z AS z_j, na, nb, nc, b.x - a.x + (na * ax + nb * bx + nc * cx) AS dx, b.y - a.y + (na * ay + nb * b_y + nc * cy) AS dy, b.w - a.w + (na * az + nb * bz + nc * cz) AS dz
  FROM sites a JOIN sites b USING (structure_id) JOIN cells USING (structure_id), {cells} s(na), {cells} t(nb), {cells} u(nc) WHERE periodic = 1 OR (na = 0 AND nb = 0 AND nc = 0)),
pairs AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM moved WHERE sqrt(dx * dx + dy * dy + dz * dz) > 1e-10 AND sqrt(dx * dx + dy * dy + dz * dz) < {rcut} AND NOT (i = j AND na = 0 AND nb = 0 AND nc = 0)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY structure_id, i ORDER BY j, na, nb, nc) AS o FROM pairs)"""


def block(tuples: str, name: str, offset: int, by: str = "w") -> str:
    """(structure_id, i, channel, v) of a block of features."""
    return f"SELECT structure_id, i, (channel + {offset})::INT AS channel, sum({by} * value) AS v FROM ({tuples}) JOIN {name} USING (idx) GROUP BY ALL"


def three_block(idx: str, weight_: str, offset: int) -> str:
    w = f"2 * pow(z_i::DOUBLE * z_p * z_q, {1 / 3!r}::DOUBLE) * {weight_}"
    return block(f"SELECT structure_id, i, {idx} AS idx, {w} AS w, {w} * cos2 * cos3 AS wc FROM triples", "angular", offset, "(CASE WHEN channel % 4 = 0 THEN wc ELSE w END)")


def closed(rcut: float) -> str:
    return f"{cut('r_p', rcut)} * {cut('r_q', rcut)} * (CASE WHEN r_pq < {rcut} THEN {cut('r_pq', rcut)} ELSE 0 END) / pow(r_p * r_q * r_pq, 2)"


def whole(rcut: float, n: int, angle: int) -> str:
    """Two- and three-body blocks of five orders."""
    two = block(f"SELECT structure_id, i, {cell('r', rcut, n)} AS idx, sqrt(z_i::DOUBLE * z_j) * {cut('r', rcut)} AS w FROM pairs", "radial", 0)
    return f"{two} UNION ALL {three_block(cell('acos(cos1)', math.pi, angle), closed(rcut), 20)}"


def framed(structures: str, channels: int, value: str) -> str:
    return f"SELECT s.structure_id::BIGINT AS structure_id, c.v::INT AS channel, {value} AS value FROM {structures} s CROSS JOIN range({channels}) c(v) LEFT JOIN (SELECT structure_id, channel, sum(v) AS v FROM f GROUP BY ALL) g ON g.structure_id = s.structure_id AND g.channel = c.v"


_w = lambda root, z, r, rcut: f"pow({' * '.join(f'{x}::DOUBLE' for x in z)}, {1 / root!r}::DOUBLE) * {' * '.join(cut(x, rcut) for x in r)} / ({' * '.join(r)})"
_four = f"SELECT structure_id, i, {cell(_omega, 2 * math.pi, 1260)} AS idx, {_w(4, ['z_i', 'z_p', 'z_q', 'z_s'], ['r_p', 'r_q', 'r_s'], 3.2)} AS w FROM quads"
_five = " UNION ALL ".join(f"SELECT structure_id, i, {cell(_psi(*[n for n in 'pqst' if n != m], m), math.pi, 630)} AS idx, {_w(5, ['z_i', 'z_p', 'z_q', 'z_s', 'z_t'], ['r_p', 'r_q', 'r_s', 'r_t'], 3.2)} AS w FROM quints" for m in "pqst")
_face = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]
_sites = [(x + i, y + j, z) for i in range(2) for j in range(2) for x, y, z in _face]
_values = ", ".join(f"({s}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for s, (x, y, z) in enumerate(_sites))
_move = lambda c, n, m: f"{c} * a + (k * ({n}) % {m}) / {10.0 * m}::DOUBLE"
_generated = f"""keys AS (SELECT s_suppkey AS k, 3.8::DOUBLE + (s_suppkey % 11) / 10.0::DOUBLE AS a FROM supplier), places AS (SELECT * FROM (VALUES {_values}) p(s, px, py, pz)),
sites AS (SELECT k AS structure_id, s::INT AS i, (1 + (k * (s % 4 + 1) + s % 3) % 83)::INT AS z, {_move('px', '3 * s + 7', 101)} AS x, {_move('py', '5 * s + 11', 103)} AS y, {_move('pz', '7 * s + 13', 107)} AS w FROM keys, places),
cells AS (SELECT k AS structure_id, 2 * a AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS az, 0.0::DOUBLE AS bx, 2 * a AS b_y, 0.0::DOUBLE AS bz, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, a AS cz, 1 AS periodic FROM keys)"""
SQL["generated_crystals"] = f"""WITH {_generated}, {image_pairs(5.0, 2)}, {THREE}, {plan_grid('radial', 5.0, 500, 5)}, {plan_grid('angular', 0, 630, 5)}, f AS ({whole(5.0, 500, 630)})
{framed('cells', 40, squeezed('coalesce(g.v, 0)'))}"""
SQL["periodic_features"] = f"""WITH {_generated}, {image_pairs(3.2, 2)}, {THREE.replace('t AS (', 't3 AS (', 1).replace('FROM t WHERE', 'FROM t3 WHERE').replace('u AS (', 'u3 AS (', 1).replace('FROM u)', 'FROM u3)')},
q0 AS (SELECT p.structure_id, p.i, p.z_i, {_legs('pqs')} FROM {_join('pqs')}), quads AS (SELECT *, {unit('p')}, {unit('q')}, {unit('s')} FROM q0), quints AS (SELECT p.structure_id, p.i, p.z_i, {_legs('pqst')} FROM {_join('pqst')}),
{plan_grid('radial', 3.2, 320, 5)}, {plan_grid('angular', 0, 630, 5)}, {plan_grid('solid', 0, 1260, 5)}, {plan_grid('plane', 0, 630, 4)},
f AS ({whole(3.2, 320, 630)} UNION ALL {block(_four, 'solid', 40)} UNION ALL {block(_five, 'plane', 60)})
{framed('cells', 72, squeezed('coalesce(g.v, 0)'))}"""
SQL["crystal_neighbors"] = f"""WITH {_generated}, {image_pairs(6.0, 3)} SELECT structure_id::BIGINT AS structure_id, i, count(*) AS n, {R('sum(r)', 5)} AS sum_r FROM pairs GROUP BY structure_id, i"""
# a crystal repeated 36 times has 36 times the pairs
SQL["mixed_size_neighbors"] = f"""WITH {_generated}, {image_pairs(4.15, 2)} SELECT structure_id::BIGINT AS structure_id, (count(*) * CASE WHEN structure_id % 10 = 0 THEN 36 ELSE 1 END)::BIGINT AS n, {R('avg(r)', 5)} AS mean_r FROM pairs GROUP BY structure_id"""
_frames = image_pairs(4.15, 2).replace("sites a JOIN sites b", "sites_t a JOIN sites_t b").replace("cells USING", "cells_t USING")
SQL["trajectory_neighbors"] = f"""WITH {_generated}, sites_t AS (SELECT structure_id * 8 + t AS structure_id, i, z, x + t * 0.06::DOUBLE * (i % 3 - 1) AS x, y + t * 0.06::DOUBLE * ((i + 1) % 3 - 1) AS y, w + t * 0.06::DOUBLE * ((i + 2) % 3 - 1) AS w FROM sites, range(8) r(t)),
cells_t AS (SELECT c.* REPLACE (structure_id * 8 + t AS structure_id) FROM cells c, range(8) r(t)), {_frames}
SELECT (structure_id // 8)::BIGINT AS structure_id, (structure_id % 8)::INT AS frame, count(*) AS n, {R('sum(r)', 4)} AS sum_r FROM pairs GROUP BY ALL"""
SQL["supercell"] = f"""WITH {_generated} SELECT structure_id::BIGINT AS structure_id, z, count(*) AS n, {R('sum(x + na * ax + nc * cx)', 5)} AS sum_x, {R('sum(y + na * ay + nc * cy)', 5)} AS sum_y, {R('sum(w + na * az + nc * cz)', 5)} AS sum_z
  FROM sites JOIN cells USING (structure_id), range(2) s(na), range(3) u(nc) GROUP BY structure_id, z"""


# lattice points of the larger cell are those with coordinates in [0, 1): n times the adjugate of the matrix, over its determinant of 4
SQL["matrix_supercell"] = f"""WITH {_generated}, n AS (SELECT na, nb, nc FROM range(-4, 5) s(na), range(-4, 5) t(nb), range(-4, 5) u(nc)
  WHERE 2 * na + 2 * nb - nc BETWEEN 0 AND 3 AND -2 * na + 2 * nb - nc BETWEEN 0 AND 3 AND 2 * nc BETWEEN 0 AND 3)
SELECT structure_id::BIGINT AS structure_id, z, count(*) AS n, {R('sum(x + na * ax)', 4)} AS sum_x, {R('sum(y + nb * b_y)', 4)} AS sum_y, {R('sum(w + nc * cz)', 4)} AS sum_zc, {R('any_value(ax + 10 * b_y + 200 * cz)', 5)} AS cell
FROM sites JOIN cells USING (structure_id), n GROUP BY structure_id, z"""
SQL["miller_slab"] = f"""WITH {_generated}, p AS (SELECT *, sqrt(1 / (ax * ax) + 1 / (b_y * b_y) + 4 / (cz * cz)) AS g FROM cells),
h AS (SELECT structure_id, (x / ax + y / b_y + 2 * w / cz) / g AS low, 1 / g AS step, ax * b_y * cz * g AS area FROM sites JOIN p USING (structure_id))
SELECT structure_id::BIGINT AS structure_id, (2 * count(*))::INT AS n, {R('sum(2 * low + step)', 4)} AS heights, {R('any_value(2 * step + 10)', 5)} AS height, {R('any_value(area)', 4)} AS area, false AS open_side FROM h GROUP BY structure_id"""


def _dense(w: list[list[float]], b: list[float], inputs: list[str]) -> list[str]:
    return [f"({' + '.join(f'{x!r}::DOUBLE * {c}' for x, c in zip(row, inputs, strict=True))} + {bias!r}::DOUBLE)" for row, bias in zip(w, b, strict=True)]


def _layer(seed: int, out: int, into: int, inputs: list[str], prefix: str) -> str:
    """Columns of a dense layer with the fixed weights of a seed."""
    return ", ".join(f"{e} AS {prefix}{k}" for k, e in enumerate(_dense(waves(seed, out, into), waves(seed + 1, 1, out)[0], inputs)))


def _network(start: str, factor: list[str], more: str = "") -> str:
    h, silu = ["h0", "h1", "h2"], lambda n: [f"{n}{k} / (1 + exp(-{n}{k}))" for k in range(3)]
    ctes, now = [f"s0 AS ({start})"], "s0"
    for k in range(2):
        ctes += [
            f"a{k} AS (SELECT *, {_layer(10 + 20 * k, 3, 3, h, 'a')} FROM {now})",
            f"m{k} AS (SELECT *, {_layer(20 + 20 * k, 3, 3, silu('a'), 'm')} FROM a{k})",
            f"g{k} AS (SELECT e.structure_id, e.j AS atom_id, {', '.join(f'sum(m{c} * {factor[c]}) AS g{c}' for c in range(3))} FROM edges e JOIN m{k} ON m{k}.structure_id = e.structure_id AND m{k}.atom_id = e.i GROUP BY e.structure_id, e.j)",
            f"b{k} AS (SELECT s.structure_id, s.atom_id, h0, h1, h2, {', '.join(f'coalesce(g{c}, 0) AS g{c}' for c in range(3))} FROM {now} s LEFT JOIN g{k} USING (structure_id, atom_id))",
            f"c{k} AS (SELECT *, {_layer(50 + 20 * k, 3, 6, [*h, 'g0', 'g1', 'g2'], 'c')} FROM b{k})",
            f"d{k} AS (SELECT *, {_layer(60 + 20 * k, 3, 3, silu('c'), 'd')} FROM c{k})",
            f"s{k + 1} AS (SELECT structure_id, atom_id, {', '.join(f'h{c} + d{c} AS h{c}' for c in range(3))} FROM d{k})",
        ]
        now = f"s{k + 1}"
    ctes += [f"o AS (SELECT *, {_layer(90, 3, 3, h, 'a')} FROM {now})", f"p AS (SELECT *, {_layer(100, 1, 3, silu('a'), 'p')} FROM o)"]
    return f"WITH {pairs(4)}, {more}{', '.join(ctes)} SELECT structure_id, {R('sum(p0)', 5)} AS p FROM p GROUP BY structure_id"


_edges = f"edges AS (SELECT structure_id, i, j, r, {cut('r', 4)} AS e FROM pairs), "
SQL["weighted_network"] = _network(f"SELECT structure_id, atom_id, {_layer(1, 3, 2, ['(z / 92.0::DOUBLE)', '(x / 10.0::DOUBLE)'], 'h')} FROM atoms", ["e"] * 3, _edges)
_far = f"far AS (SELECT *, {_layer(110, 3, 1, ['r'], 'q')} FROM pairs), edges AS (SELECT structure_id, i, j, {', '.join(f'{e} * {cut("r", 4)} AS e{k}' for k, e in enumerate(_dense(waves(120, 3, 3), waves(121, 1, 3)[0], [f'q{k} / (1 + exp(-q{k}))' for k in range(3)])))} FROM far), "
_vectors = ", ".join(f"({z}, {', '.join(f'{x!r}::DOUBLE' for x in waves(z, 1, 3)[0])})" for z in range(1, 93))
SQL["element_network"] = _network("SELECT structure_id, atom_id, h0, h1, h2 FROM atoms JOIN starts USING (z)", ["e0", "e1", "e2"], f"starts AS (SELECT * FROM (VALUES {_vectors}) v(z, h0, h1, h2)), {_far}")


def _swept() -> str:
    """Eight settings one after the other, each on a grid of its own; triples of the largest cutoff are cut down."""
    grids, parts = [], []
    for k, (rcut, order, damping) in enumerate((r, o, d) for r in (4.0, 5.0) for o in (1, 3) for d in (1, 2)):
        n, first = int(rcut * 20), 4 * (order + 1)
        grids += [grid(f"radial{k}", rcut, n, RADIAL_W, 2.0, math.sqrt(2.0), 1, order + 1, _minus ** (order + 1)), grid(f"angular{k}", math.pi, 63, COS4, 2.0, math.sqrt(2.0), 1, order + 1, _minus ** (order + 1))]
        two = block(f"SELECT structure_id, i, {cell('r', rcut, n)} AS idx, sqrt(z_i::DOUBLE * z_j) * {cut('r', rcut)} AS w FROM pairs WHERE r < {rcut}", f"radial{k}", 0)
        three = three_block(cell("acos(cos1)", math.pi, 63), closed(rcut).replace(", 2)", f", {damping})"), first).replace("FROM triples", f"FROM triples WHERE r_p < {rcut} AND r_q < {rcut}").replace("JOIN angular", f"JOIN angular{k}")
        parts.append(f"SELECT {k}::INT AS setting, s.structure_id::BIGINT AS structure_id, c.v::INT AS channel, {squeezed('coalesce(g.v, 0)')} AS value FROM cells s CROSS JOIN range({2 * first}) c(v) LEFT JOIN (SELECT structure_id, channel, sum(v) AS v FROM ({two} UNION ALL {three}) GROUP BY ALL) g ON g.structure_id = s.structure_id AND g.channel = c.v")
    return f"WITH {_generated}, {image_pairs(5.0, 2)}, {THREE}, {', '.join(grids)} {' UNION ALL '.join(parts)}"


SQL["feature_sweep"] = _swept()


def _pulled(name: str, n: int, keep: str, first: int) -> str:
    """(idx, v, d): a grid contracted with slopes of alternating sign that fall as 1 / channel, and its change to the next point."""
    step = f"({(4.0 if name == 'radial' else math.pi) / n!r}::DOUBLE)"
    total = f"SELECT idx, sum(CASE WHEN {keep} THEN (CASE WHEN (channel + {first}) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) / (channel + {first} + 1) * value ELSE 0 END) AS v FROM {name} GROUP BY idx"
    return f"SELECT idx, v, coalesce(lead(v) OVER (ORDER BY idx) - v, 0) / {step} AS d FROM ({total})"


_inside = lambda v, domain, n: f"(greatest(0, least(1, {v} / {domain / n!r}::DOUBLE - {cell(v, domain, n)})) * {domain / n!r}::DOUBLE)"
_cutd = lambda r: f"(-{PI} * sin({PI} * {r} / 4.0::DOUBLE) / 8.0::DOUBLE)"
_c3 = {"a": "r_p", "b": "r_q", "c": "r_pq"}
_scale = f"2 * pow(z_i::DOUBLE * z_p * z_q, {1 / 3!r}::DOUBLE) / pow(r_p * r_q * r_pq, 2)"
_slope_of = {
    "a": (f"{cut('r_q', 4.0)} * {cut('r_pq', 4.0)} * ({_cutd('r_p')} - 2 * {cut('r_p', 4.0)} / r_p)", "(a - b * c1) / (a * b)", "(a - c * cp) / (a * c)", "-a / (b * c)"),
    "b": (f"{cut('r_p', 4.0)} * {cut('r_pq', 4.0)} * ({_cutd('r_q')} - 2 * {cut('r_q', 4.0)} / r_q)", "(b - a * c1) / (a * b)", "-b / (a * c)", "(b - c * cq) / (b * c)"),
    "c": (f"{cut('r_p', 4.0)} * {cut('r_q', 4.0)} * ({_cutd('r_pq')} - 2 * {cut('r_pq', 4.0)} / r_pq)", "-c / (a * b)", "(c - a * cp) / (a * c)", "(c - b * cq) / (b * c)"),
}
_energy = ", ".join(f"scale * ({w}) * (va + cp * cq * vb) + scale * {cut('r_p', 4.0)} * {cut('r_q', 4.0)} * {cut('r_pq', 4.0)} * (-(da + cp * cq * db) * ({t}) / sqrt(greatest(1 - c1 * c1, 1e-12)) + (({hp}) * cq + cp * ({hq})) * vb) AS e{k}" for k, (w, t, hp, hq) in _slope_of.items())
_axes = "xyz"
SQL["model_forces"] = f"""WITH {pairs(4)}, {ORDERED}, {THREE}, {plan_grid('radial', 4.0, 80, 2)}, {plan_grid('angular', 0, 63, 2)},
two AS ({_pulled('radial', 80, 'true', 0)}), plain AS ({_pulled('angular', 63, 'channel % 4 <> 0', 8)}), outer_ AS ({_pulled('angular', 63, 'channel % 4 = 0', 8)}),
p2 AS (SELECT structure_id, i, j, dx, dy, dz, sqrt(z_i::DOUBLE * z_j) * ({_cutd('r')} * (v + d * {_inside('r', 4.0, 80)}) + {cut('r', 4.0)} * d) / r AS c FROM pairs JOIN two ON two.idx = {cell('r', 4.0, 80)}),
t0 AS (SELECT *, r_p AS a, r_q AS b, r_pq AS c, {_scale} AS scale, cos1 AS c1, (r_p * r_p + r_pq * r_pq - r_q * r_q) / (2 * r_p * r_pq) AS cp, (r_q * r_q + r_pq * r_pq - r_p * r_p) / (2 * r_q * r_pq) AS cq, {cell('acos(cos1)', math.pi, 63)} AS idx, {_inside('acos(cos1)', math.pi, 63)} AS f FROM triples),
t1 AS (SELECT t0.*, x.v + x.d * f AS va, x.d AS da, y.v + y.d * f AS vb, y.d AS db FROM t0 JOIN plain x USING (idx) JOIN outer_ y USING (idx)),
t2 AS (SELECT structure_id, i, p, q, a, b, c, {', '.join(f'{n}{x}' for n in 'pq' for x in _axes)}, {_energy} FROM t1),
t3 AS (SELECT structure_id, i, p, q, {', '.join(f"ea * p{x} / a + ec * (p{x} - q{x}) / c AS m{x}, eb * q{x} / b + ec * (q{x} - p{x}) / c AS n{x}" for x in _axes)} FROM t2),
pushed AS (SELECT structure_id, j AS atom_id, {', '.join(f'c * d{x} AS {x}' for x in _axes)} FROM p2 UNION ALL SELECT structure_id, i, {', '.join(f'-c * d{x}' for x in _axes)} FROM p2
  UNION ALL SELECT structure_id, p, mx, my, mz FROM t3 UNION ALL SELECT structure_id, q, nx, ny, nz FROM t3 UNION ALL SELECT structure_id, i, -mx - nx, -my - ny, -mz - nz FROM t3),
s AS (SELECT structure_id, atom_id, {', '.join(f'-sum({x}) AS {x}' for x in _axes)} FROM pushed GROUP BY structure_id, atom_id)
SELECT atoms.structure_id, atoms.atom_id, {', '.join(squeezed(f'coalesce(s.{x}, 0)') + f' AS f{x}' for x in _axes)} FROM atoms LEFT JOIN s ON s.structure_id = atoms.structure_id AND s.atom_id = atoms.atom_id"""

_few = ATOMS.replace("(1 + l_partkey % 92)::INT AS z", "((1 + l_partkey % 92) % 5 + 1)::INT AS z")
_two8 = block(f"SELECT structure_id, i, {cell('r', 5.0, 100)} AS idx, sqrt(z_i::DOUBLE * z_j) * {cut('r', 5)} AS w FROM pairs", "radial", 0)
_three8 = three_block(cell("acos(cos1)", math.pi, 63), f"{cut('r_p', 5)} * {cut('r_q', 5)} * {cut('r_pq', 5)} / (r_p * r_q * r_pq)", 8)
SQL["molecular_features"] = f"""WITH {pairs(5).replace(ATOMS, _few)}, {ORDERED}, {THREE}, {plan_grid('radial', 5.0, 100, 2)}, {plan_grid('angular', 0, 63, 2)}, f AS ({_two8} UNION ALL {_three8}),
e AS (SELECT a.structure_id, a.z, c.v AS channel, coalesce(f.v, 0) AS v FROM atoms a CROSS JOIN range(16) c(v) LEFT JOIN f ON f.structure_id = a.structure_id AND f.i = a.atom_id AND f.channel = c.v),
n AS (SELECT z, channel, CASE WHEN avg(abs(v)) = 0 THEN 1 ELSE avg(abs(v)) END AS factor FROM e GROUP BY z, channel),
sizes AS (SELECT sum(size) AS size FROM (SELECT z, max(k) AS size FROM (SELECT z, count(*) AS k FROM atoms GROUP BY structure_id, z) GROUP BY z))
SELECT structure_id, (16 * any_value(size))::INT AS n, {R('sum(abs(v / factor))', 3)} AS total FROM e JOIN n USING (z, channel), sizes GROUP BY structure_id"""

_two20 = block(f"SELECT structure_id, i, {near_cell('r', 4.0, 80)} AS idx, sqrt(z_i::DOUBLE * z_j) AS w FROM pairs", "radial", 0)
_three20 = three_block(near_cell("acos(cos1)", math.pi, 63), "1 / pow(r_p * r_q * r_pq, 2)", 20)
_legacy25 = block(f"SELECT structure_id, i, {near_cell('mu5', 4.0, 80)} AS idx, sqrt(sqrt(z_i::DOUBLE * z_p * z_q * z_s)) * e5 / pow(r_p * r_q * r_s, 2) AS w FROM legacy5", "legacy", 40)
_close = " JOIN ".join(f"(SELECT * FROM ordered WHERE r < 3) {n}" + (f" ON p.structure_id = {n}.structure_id AND p.i = {n}.i" if n != "p" else "") for n in "pqs")
SQL["legacy_features"] = f"""WITH {pairs(4)}, {ORDERED}, {THREE}, l AS (SELECT p.structure_id, p.i, p.z_i, {_legs('pqs')}, {_gaps} FROM {_close}), {_fold},
{plan_grid('radial', 4.0, 80, 5)}, {plan_grid('angular', 0, 63, 5)}, {plan_grid('legacy', 4.0, 80, 5)}, f AS ({_two20} UNION ALL {_three20} UNION ALL {_legacy25}),
g AS (SELECT structure_id, channel, sum(v) AS v FROM f GROUP BY structure_id, channel), totals AS (SELECT structure_id, sum(abs(v)) AS v FROM g GROUP BY structure_id)
SELECT s.structure_id, 65::INT AS n, {squeezed("coalesce(totals.v, 0)")} AS total FROM (SELECT DISTINCT structure_id FROM atoms) s LEFT JOIN totals USING (structure_id)"""

# linear models by elimination
_rows = f"{VEC}, r AS (SELECT id, f, 2 * f[1] - f[2] + f[3] * f[4] + sin(f[5]) AS y FROM v)"
_idkey = "(((id % 2147483648 * 2654435761) % 4294967296 * 36024039 + 18012019) % 4294967296)"


def products(rows: str, keys: str = "") -> str:
    """xx (64 rows of 64), xy and yy of rows (keys, f, y), by keys."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""cells2 AS (SELECT {k}a.v AS a, b.v AS b, sum(f[a.v] * f[b.v]) AS s FROM {rows}, range(1, 65) a(v), range(1, 65) b(v) GROUP BY {k}a.v, b.v),
lines AS (SELECT {k}a, list(s ORDER BY b) AS s FROM cells2 GROUP BY {k}a), xx AS (SELECT {keys or '0 AS one'}, list(s ORDER BY a) AS xx FROM lines {g}),
marks AS (SELECT {k}a.v AS a, sum(f[a.v] * y) AS s FROM {rows}, range(1, 65) a(v) GROUP BY {k}a.v), xy AS (SELECT {keys or '0 AS one'}, list(s ORDER BY a) AS xy FROM marks {g}),
yy AS (SELECT {keys or '0 AS one'}, sum(y * y) AS yy, count(*) AS n FROM {rows} {g})"""


def eliminated(start: str, keys: str, width: int) -> str:
    """Gauss-Jordan steps on start(keys, m), m of 64 rows; the matrix is positive definite, so no row is exchanged."""
    step = f"list_transform(range(1, 65), lambda i: CASE WHEN i = k + 1 THEN m[i] ELSE list_transform(range(1, {width + 1}), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)"
    return f"steps AS (SELECT {keys}, 0 AS k, m FROM {start} UNION ALL SELECT {keys}, k + 1, {step} FROM steps WHERE k < 64), solved AS (SELECT {keys}, m FROM steps WHERE k = 64)"


_unit = "list_transform(range(1, 65), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_quad = lambda w, m: f"list_sum(list_transform(range(1, 65), lambda i: {w}[i] * list_sum(list_transform(range(1, 65), lambda j: {w}[j] * {m}[i][j]))))"
_dot = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
SQL["ridge_predict"] = f"""WITH RECURSIVE {_rows}, stats AS (SELECT list(m ORDER BY c) AS m, list(s ORDER BY c) AS s FROM (SELECT channel AS c, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM long GROUP BY channel)),
mid AS (SELECT avg(y) AS y0 FROM r), scaled AS (SELECT id, list_transform(range(1, 65), lambda k: (r.f[k] - stats.m[k]) / stats.s[k]) AS f, r.y - mid.y0 AS y FROM r, stats, mid),
{products('scaled')}, start AS (SELECT alpha, list_transform(range(1, 65), lambda i: list_concat(list_transform(range(1, 65), lambda j: xx[i][j] + CASE WHEN i = j THEN alpha ELSE 0.0::DOUBLE END), {_unit}, [xy[i]])) AS m FROM xx, xy, (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) a(alpha)),
{eliminated('start', 'alpha', 129)}, fits AS (SELECT alpha, list_transform(range(1, 65), lambda i: m[i][129] / m[i][i]) AS w, list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][64 + j] / m[i][i])) AS inv FROM solved),
errors AS (SELECT alpha, avg(pow((y - {_dot('w', 'f')}) / (1 - 1.0::DOUBLE / n - {_quad('f', 'inv')}), 2)) AS e FROM scaled, fits, yy GROUP BY alpha),
best AS (SELECT alpha, w FROM fits JOIN errors USING (alpha) ORDER BY e, alpha LIMIT 1)
SELECT id, {R(f"y0 + {_dot('w', 'f')}", 5)} AS p, alpha FROM scaled, mid, best"""
_folds = f"dealt AS (SELECT f, y, ntile(4) OVER (ORDER BY {_idkey}, id) AS fold FROM r), {products('dealt', 'fold')}"
_rest = """plus AS (SELECT a.fold, list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: t.xx[i][j] - a.xx[i][j])) AS xx FROM xx a, total t),
minus AS (SELECT a.fold, list_transform(range(1, 65), lambda i: t.xy[i] - a.xy[i]) AS xy FROM xy a, total_y t)"""
_total = """total AS (SELECT list(s ORDER BY a) AS xx FROM (SELECT a, list(s ORDER BY b) AS s FROM (SELECT a, b, sum(s) AS s FROM cells2 GROUP BY a, b) GROUP BY a)), total_y AS (SELECT list(s ORDER BY a) AS xy FROM (SELECT a, sum(s) AS s FROM marks GROUP BY a))"""
_lost = f"(yy - 2 * {_dot('w', 'h.xy')} + {_quad('w', 'g.xx')})"
SQL["leave_one_feature_out"] = f"""WITH RECURSIVE {_rows}, {_folds}, {_total}, {_rest},
start AS (SELECT fold, list_transform(range(1, 65), lambda i: list_concat(list_transform(range(1, 65), lambda j: xx[i][j] + CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), {_unit}, [xy[i]])) AS m FROM plus JOIN minus USING (fold)),
{eliminated('start', 'fold', 129)}, fits AS (SELECT fold, list_transform(range(1, 65), lambda i: m[i][129] / m[i][i]) AS w, list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][64 + j] / m[i][i])) AS inv FROM solved),
sets AS (SELECT fold, -1 AS channel, w FROM fits UNION ALL SELECT fold, c.v - 1, list_transform(range(1, 65), lambda i: CASE WHEN i = c.v THEN 0.0::DOUBLE ELSE w[i] - inv[i][c.v] * w[c.v] / inv[c.v][c.v] END) FROM fits, range(1, 65) c(v)),
e AS (SELECT channel, sum({_lost}) AS e FROM sets JOIN xx g USING (fold) JOIN xy h USING (fold) JOIN yy USING (fold) GROUP BY channel)
SELECT a.channel::INT AS channel, {R('a.e - b.e', 4)} AS rise FROM e a JOIN e b ON b.channel = -1 WHERE a.channel >= 0"""
_sets = {"all": range(40), "radial": range(20), "angular": range(20, 40), "every": range(64), "rest": range(40, 64)} | {f"order<={m}": [*range(4 * m + 4), *range(20, 24 + 4 * m)] for m in range(5)}
_in = "(CASE WHEN list_contains(keep, i) AND list_contains(keep, j) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
SQL["feature_ablation"] = f"""WITH RECURSIVE {_rows}, {_folds}, {_total}, {_rest}, sets AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {[k + 1 for k in keep]})" for n, keep in _sets.items())}) s(name, keep)),
start AS (SELECT fold, name, list_transform(range(1, 65), lambda i: list_concat(list_transform(range(1, 65), lambda j: xx[i][j] * {_in} + CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), [CASE WHEN list_contains(keep, i) THEN xy[i] ELSE 0.0::DOUBLE END])) AS m FROM plus JOIN minus USING (fold), sets),
{eliminated('start', 'fold, name', 65)}, fits AS (SELECT fold, name, list_transform(range(1, 65), lambda i: m[i][65] / m[i][i]) AS w FROM solved)
SELECT name AS features, {R(f'sum({_lost})', 4)} AS error FROM fits JOIN xx g USING (fold) JOIN xy h USING (fold) JOIN yy USING (fold) GROUP BY name"""

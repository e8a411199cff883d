"""SQL that repeats the fits step by step: coarse grid, then damped Gauss-Newton steps, over the test-day view.

Each relation has one row per lactation and candidate; the linear parameters come from sums over its days. ``walk`` is
recursive: a round probes the curve beside the best point, takes the slopes of the residuals, tries three dampings and four step
lengths, and keeps the best, until a lactation no longer improves.
"""

from __future__ import annotations

import re

import numpy as np

from dairyframe.functions import bounded_fit as bf
from dairyframe.operators import fitting

#: u and v of the curve p * u + q * v, with e1 and e2 the search parameters; wood has no v.
SHAPES = {
    "wood": ("exp(e1 * ln(t) - e2 * t)", "0.0"),
    "fischer": ("1 - exp(-e1 * t)", "-t"),
    "milkbot": ("exp(-e2 * t)", "-exp(-t / e1) * exp(-e2 * t)"),
}
SHAPES["milkbot_trf"] = SHAPES["milkbot"]


#: The least residual sum first, equal ones by candidate.
LEAST = f"{{'r': round(sse / CASE WHEN yy > 0 THEN yy ELSE 1 END, {bf.DECIDES}), 'k': k, 's': sse, 'x1': x1, 'x2': x2, 'p': p, 'q': q}}"


def _clip(top: str, bottom: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN least(greatest(({top}) / ({bottom}), {lo}), {hi}) ELSE least(greatest({lo}, {lo}), {hi}) END"


def _choices(model: str) -> list[tuple[str, str, str]]:
    """(p, q, valid) in the order in which the fit tries them."""
    limits = [(repr(lo), repr(hi)) for lo, hi in fitting.BOUNDS[model].linear]
    if model == "wood":
        return [(_clip("uy", "uu", *limits[0]), "0.0", "true")]
    free_p, free_q = "(uy * vv - vy * uv) / nullif(uu * vv - uv * uv, 0)", "(uu * vy - uv * uy) / nullif(uu * vv - uv * uv, 0)"
    if model == "fischer":
        (alo, ahi), (blo, bhi) = limits
        out = [(free_p, free_q, f"fp BETWEEN {alo} AND {ahi} AND fq BETWEEN {blo} AND {bhi}")]
        out += [(a, _clip(f"vy - {a} * uv", "vv", blo, bhi), "true") for a in (alo, ahi)]
        return out + [(_clip(f"uy - {b} * uv", "uu", alo, ahi), b, "true") for b in (blo, bhi)]
    (alo, ahi), (clo, chi) = limits
    if model == "milkbot_trf":
        alo, ahi = f"({alo} * top)", f"({ahi} * top)"
    rlo, rhi = f"(exp({clo} / e1) / 2)", f"(exp(least({chi} / e1, 600.0)) / 2)"
    out = [(free_p, free_q, f"fp BETWEEN {alo} AND {ahi} AND fq >= fp * {rlo} AND fq <= fp * {rhi}")]
    out += [(a, _clip(f"vy - {a} * uv", "vv", f"{a} * {rlo}", f"{a} * {rhi}"), "true") for a in (alo, ahi)]
    for r in (rlo, rhi):
        p = _clip(f"uy + {r} * vy", f"uu + 2 * {r} * uv + {r} * {r} * vv", alo, ahi)
        out.append((p, f"({p}) * {r}", "true"))
    return out


def _solved(model: str, candidates: str, carry: str) -> str:
    """Rows of ``candidates`` (test_id, k, x1, x2, ``carry``) with the best p and q and the residual sum."""
    u, v = SHAPES[model]
    kept = "".join(f", any_value({c}) AS {c}" for c in carry.split())
    names = "".join(f", {c}" for c in carry.split())
    rows = []
    for i, (p, q, valid) in enumerate(_choices(model)):
        rows.append((f"{p} AS p{i}, {q} AS q{i}", valid.replace("fp", f"p{i}").replace("fq", f"q{i}"), i))
    sums = f"""SELECT test_id, k, any_value(x1) AS x1, any_value(x2) AS x2{kept}, any_value(e1) AS e1, any_value(e2) AS e2,
               sum(w * u * u) AS uu, sum(w * u * v) AS uv, sum(w * v * v) AS vv, sum(w * u * y) AS uy, sum(w * v * y) AS vy
        FROM (SELECT *, {u} AS u, {v} AS v FROM (SELECT *, exp(x1) AS e1, exp(x2) AS e2 FROM ({candidates})) JOIN days USING (test_id)) GROUP BY test_id, k"""
    tried = f"SELECT s.*, yy, top, {', '.join(r[0] for r in rows)} FROM ({sums}) s JOIN lact USING (test_id)"
    priced = ", ".join(
        f"CASE WHEN {valid} THEN yy - 2 * (p{i} * uy + q{i} * vy) + p{i} * p{i} * uu + 2 * p{i} * q{i} * uv + q{i} * q{i} * vv END AS s{i}" for _, valid, i in rows
    )
    best = ", ".join(f"{{'s': CASE WHEN s{i} IS NULL OR NOT isfinite(s{i}) THEN 1e308 ELSE s{i} END, 'i': {i}, 'p': p{i}, 'q': q{i}}}" for *_, i in rows)
    return f"SELECT test_id, k, x1, x2{names}, z.s AS sse, z.p AS p, z.q AS q FROM (SELECT *, list_sort([{best}])[1] AS z FROM (SELECT *, {priced} FROM ({tried})))"


def _limits(model: str) -> tuple[list[str], list[str], int]:
    search = fitting.BOUNDS[model].search
    lo, hi = (list(map(repr, map(float, np.log([b[i] for b in search])))) for i in (0, 1))
    return lo + ["0.0"] * (2 - len(lo)), hi + ["0.0"] * (2 - len(hi)), len(search)


def bounded(model: str) -> dict[str, str]:
    """Named relations; the last, ``fitted``, has test_id, e1, e2, p, q, sse and converged."""
    needed = fitting.FREE_PARAMETERS[model]
    lo, hi, dims = _limits(model)
    steps = [f"(-1 + i{d} * {2 / (bf.COARSE - 1)!r})" for d in (0, 1)]
    axis = [f"(({lo[d]} + {hi[d]}) / 2 + {steps[d]} * ({hi[d]} - {lo[d]}) / 2)" for d in (0, 1)]
    second = f"(SELECT unnest(range(0, {bf.COARSE if dims == 2 else 1})) AS i1)"
    grid = f"SELECT test_id, i0 * {bf.COARSE} + i1 AS k, {axis[0]} AS x1, {axis[1] if dims == 2 else '0.0'} AS x2 FROM lact, (SELECT unnest(range(0, {bf.COARSE})) AS i0), {second}"
    first = f"SELECT test_id, min({LEAST}) AS z FROM ({_solved(model, grid, '')}) JOIN lact USING (test_id) GROUP BY test_id"

    state = "b_x1 b_x2 b_p b_q b_sse nth"
    sign = [f"CASE WHEN b_x{d + 1} + {bf.NUDGE} > {hi[d]} THEN -1.0 ELSE 1.0 END" for d in (0, 1)]
    probes = f"""SELECT test_id, k, b_x1 + CASE WHEN k = 1 THEN {bf.NUDGE} * g1 ELSE 0 END AS x1, b_x2 + CASE WHEN k = 2 THEN {bf.NUDGE} * g2 ELSE 0 END AS x2, g1, g2, {', '.join(state.split())}
        FROM (SELECT test_id, x1 AS b_x1, x2 AS b_x2, p AS b_p, q AS b_q, sse AS b_sse, nth, {sign[0]} AS g1, {sign[1]} AS g2 FROM walk w(test_id, nth, x1, x2, p, q, sse, active) WHERE active AND nth < {bf.ROUNDS}),
             (SELECT unnest(range(0, {dims + 1})) AS k)"""
    wide = ", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for k in range(dims + 1) for c in ("x1", "x2", "p", "q"))
    carried = ", ".join(f"any_value({c}) AS {c}" for c in [*state.split(), "g1", "g2"])
    pivot = f"SELECT test_id, {carried}, {wide} FROM ({_solved(model, probes, state + ' g1 g2')}) GROUP BY test_id"

    def residual(k: int) -> str:
        u, v = (s.replace("e1", f"exp(x1{k})").replace("e2", f"exp(x2{k})") for s in SHAPES[model])
        return f"sqrt(w) * (y - p{k} * ({u}) - q{k} * ({v}))"

    slopes = ", ".join(f"(r{k} - r0) / ({bf.NUDGE} * g{k}) AS d{k}" for k in range(1, dims + 1)) + (", 0.0 AS d2" if dims == 1 else "")
    kept = ", ".join(f"any_value({c}) AS {c}" for c in state.split())
    normal = f"""SELECT test_id, {kept}, sum(d1 * r0) AS h1, sum(d2 * r0) AS h2, sum(d1 * d1) AS c11, sum(d1 * d2) AS c12, sum(d2 * d2) AS c22
        FROM (SELECT *, {slopes} FROM (SELECT *, {', '.join(f'{residual(k)} AS r{k}' for k in range(dims + 1))} FROM ({pivot}) JOIN days USING (test_id))) GROUP BY test_id"""
    held = [f"((b_x{d + 1} <= {lo[d]} + {bf.EDGE} AND h{d + 1} > 0) OR (b_x{d + 1} >= {hi[d]} - {bf.EDGE} AND h{d + 1} < 0) OR c{d + 1}{d + 1} <= {bf.FLAT} * yy)" for d in (0, 1)]
    if dims == 1:
        held[1] = "true"
    free = f"""SELECT test_id, {', '.join(state.split())}, CASE WHEN f1 THEN 0.0 ELSE h1 END AS h1, CASE WHEN f2 THEN 0.0 ELSE h2 END AS h2,
        CASE WHEN f1 THEN 0.0 ELSE c11 END AS c11, CASE WHEN f1 OR f2 THEN 0.0 ELSE c12 END AS c12, CASE WHEN f2 THEN 0.0 ELSE c22 END AS c22
        FROM (SELECT *, {held[0]} AS f1, {held[1]} AS f2 FROM ({normal}) JOIN lact USING (test_id))"""
    damped = f"""SELECT *, c11 + damp * (c11 + 1e-12 * greatest(c11, c22) + 1e-300) AS m11, c22 + damp * (c22 + 1e-12 * greatest(c11, c22) + 1e-300) AS m22
        FROM ({free}), (SELECT unnest({[float(x) for x in bf.DAMPING]}) AS damp, unnest(range(0, {len(bf.DAMPING)})) AS i)"""
    det = "nullif(m11 * m22 - c12 * c12, 0)"
    stepped = f"""SELECT *, least(greatest(coalesce(CASE WHEN c12 = 0 THEN -h1 / nullif(m11, 0) ELSE -(h1 * m22 - h2 * c12) / {det} END, 0), -1), 1) AS d1,
        least(greatest(coalesce(CASE WHEN c12 = 0 THEN -h2 / nullif(m22, 0) ELSE -(h2 * m11 - h1 * c12) / {det} END, 0), -1), 1) AS d2 FROM ({damped})"""
    tries = f"""SELECT test_id, i * {len(bf.LENGTHS)} + j AS k, least(greatest(b_x1 + round(d1 * len, {bf.PLACES}), {lo[0]}), {hi[0]}) AS x1, least(greatest(b_x2 + round(d2 * len, {bf.PLACES}), {lo[1]}), {hi[1]}) AS x2,
        {', '.join(state.split())} FROM ({stepped}), (SELECT unnest({[float(x) for x in bf.LENGTHS]}) AS len, unnest(range(0, {len(bf.LENGTHS)})) AS j)"""
    best = f"SELECT test_id, {kept}, min({LEAST}) AS z FROM ({_solved(model, tries, state)}) JOIN lact USING (test_id) GROUP BY test_id"
    pick = lambda c, b: f"CASE WHEN b_sse - z.s > {bf.EXACT} * yy THEN z.{c} ELSE {b} END"
    more = f"""SELECT test_id, nth + 1, {pick('x1', 'b_x1')}, {pick('x2', 'b_x2')}, {pick('p', 'b_p')}, {pick('q', 'b_q')}, {pick('s', 'b_sse')},
        b_sse - z.s > {bf.ENOUGH} * {pick('s', 'b_sse')} + {bf.EXACT} * yy FROM ({best}) JOIN lact USING (test_id)"""
    return {
        "days": "SELECT test_id, CAST(dim AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS w, avg(milk_kg) AS y FROM testday GROUP BY test_id, dim",
        "lact": f"""SELECT * FROM (SELECT test_id, sum(w * y * y) AS yy, count(*) AS n FROM days GROUP BY 1)
                   JOIN (SELECT test_id, max(milk_kg) AS top FROM testday GROUP BY 1) USING (test_id) WHERE n >= {needed}""",
        "walk": f"SELECT test_id, 0 AS nth, z.x1 AS x1, z.x2 AS x2, z.p AS p, z.q AS q, z.s AS sse, true AS active FROM ({first}) UNION ALL {more}",
        "fitted": "SELECT test_id, exp(z.x1) AS e1, exp(z.x2) AS e2, z.p AS p, z.q AS q, z.sse AS sse, NOT z.active AS converged FROM (SELECT test_id, arg_max({'x1': x1, 'x2': x2, 'p': p, 'q': q, 'sse': sse, 'active': active}, nth) AS z FROM walk GROUP BY test_id)",
    }


def digits(model: str) -> int:
    """Decimals at which fitted yields are compared: two parameters are searched to about 1e-5 kg, fewer are exact."""
    return 1 if len(fitting.BOUNDS[model].search if model in fitting.BOUNDS else ()) == 2 else 2


def ends(model: str) -> str:
    """Per lactation: days, max_dim, reason, convergence, the curve on its first and last day and the residual sum."""
    u, v = SHAPES[model]
    needed = fitting.FREE_PARAMETERS[model]
    value = lambda t: f"p * ({_on(u, t)}) + q * ({_on(v, t)})"
    return f"""SELECT test_id, CAST(days AS INTEGER) AS days, max_dim, CASE WHEN days < {needed} THEN 'too_few_days' END AS reason, converged,
        round({value("min_dim")}, {digits(model)}) AS first_fit, round({value("max_dim")}, {digits(model)}) AS last_fit, round(abs(sse), 2) AS sse
        FROM (SELECT test_id, count(DISTINCT dim) AS days, max(dim) AS max_dim, min(dim) AS min_dim FROM testday GROUP BY test_id) LEFT JOIN fitted USING (test_id)"""


def _on(shape: str, day: str) -> str:
    """A shape with its day put in place of the letter t that stands alone."""
    return re.sub(r"\bt\b", f"CAST({day} AS DOUBLE)", shape)


def basis_fit() -> str:
    """fit_ali_schaeffer: five columns made orthogonal one after the other (twice), the yields projected on them."""
    share, gap = "t / 305", "ln(305 / t)"
    text = """SELECT test_id, list(t ORDER BY t) AS ts, list(sqrt(w) ORDER BY t) AS root, list(sqrt(w) * y ORDER BY t) AS z FROM days
              WHERE test_id IN (SELECT test_id FROM lact) GROUP BY test_id"""
    for j, column in enumerate(("1.0", share, f"{share} * {share}", gap, f"{gap} * {gap}")):
        text = f"SELECT *, list_transform(list_zip(ts, root), lambda x: x[2] * ({column.replace('t /', 'x[1] /').replace('/ t)', '/ x[1])')})) AS v FROM ({text})"
        text = f"SELECT *, sqrt(list_dot_product(v, v)) AS length FROM ({text})"
        for i in [*range(j), *range(j)]:
            text = f"SELECT * EXCLUDE (v, part), list_transform(list_zip(v, q{i}), lambda x: x[1] - part * x[2]) AS v FROM (SELECT *, list_dot_product(q{i}, v) AS part FROM ({text}))"
        text = f"""SELECT * EXCLUDE (v, length, rest), list_transform(v, lambda x: CASE WHEN rest > 1e-10 * length THEN x / rest ELSE 0.0 END) AS q{j}
                   FROM (SELECT *, sqrt(list_dot_product(v, v)) AS rest FROM ({text}))"""
    text = f"SELECT *, z AS yields FROM ({text})"
    for j in range(5):
        text = f"SELECT * EXCLUDE (z, part), list_transform(list_zip(z, q{j}), lambda x: x[1] - part * x[2]) AS z FROM (SELECT *, list_dot_product(q{j}, z) AS part FROM ({text}))"
    fitted = f"""SELECT test_id, (yields[1] - z[1]) / root[1] AS first_fit, (yields[-1] - z[-1]) / root[-1] AS last_fit, list_dot_product(z, z) AS sse FROM ({text})"""
    return f"""SELECT test_id, CAST(days AS INTEGER) AS days, max_dim, CASE WHEN days < 5 THEN 'too_few_days' END AS reason, CASE WHEN days >= 5 THEN true END AS converged,
        round(first_fit, 2) AS first_fit, round(last_fit, 2) AS last_fit, round(abs(sse), 2) AS sse
        FROM (SELECT test_id, count(DISTINCT dim) AS days, max(dim) AS max_dim FROM testday GROUP BY test_id) LEFT JOIN ({fitted}) USING (test_id)"""


def basis_relations(needed: int = 5) -> dict[str, str]:
    return {
        "days": "SELECT test_id, CAST(dim AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS w, avg(milk_kg) AS y FROM testday GROUP BY test_id, dim",
        "lact": f"SELECT test_id FROM days GROUP BY 1 HAVING count(*) >= {needed}",
    }

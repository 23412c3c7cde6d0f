"""Pieces of SQL that several counterparts share: tails of distributions by quadrature, and Newton's method for Cox."""

from __future__ import annotations

#: Steps of Simpson's rule.
STEPS = 2000


def _simpson(top: str, density: str) -> str:
    """The integral from 0 to ``top`` of a density written with ``x``."""
    at = f"({top} * i / {STEPS}.0)"
    return f"({top} / {3 * STEPS}.0 * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('{x}', at)})))"


def normal_p(z: str) -> str:
    """Two-sided p of a normal statistic."""
    z = f"least(abs({z}), 40.0)"
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {_simpson(z, 'exp(-{x} * {x} / 2)')})"


def t_p(t: str, df: str) -> str:
    """Two-sided p of a t statistic."""
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi() * {df}) * {_simpson(f'abs({t})', f'pow(1 + {{x}} * {{x}} / {df}, -({df} + 1) / 2.0)')})"


def t_p_by_angle(t: str, df: str) -> str:
    """``t_p`` with x = sqrt(df) * tan(angle): the steps stay fine however large t is."""
    density = _simpson(f"atan(abs({t}) / sqrt({df}))", f"pow(cos({{x}}), {df} - 1)")
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {density})"


def digamma(x: str) -> str:
    y = f"({x} + 30)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - list_sum(list_transform(range(0, 30), lambda i: 1 / ({x} + i))))"


def trigamma(x: str) -> str:
    y = f"({x} + 30)"
    return f"(1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + list_sum(list_transform(range(0, 30), lambda i: 1 / pow({x} + i, 2))))"


def ranked(value: str, by: str) -> str:
    """A rank within a group, ties sharing the mean."""
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0"


#: Numbers of sign patterns of 1..n by their sum, for n to 50 (``ways``): the null of a signed-rank sum.
SIGNED_NULL = "sn AS (SELECT 0 AS n, list_transform(range(0, 1276), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS ways UNION ALL SELECT n + 1, list_transform(range(1, 1277), lambda k: ways[k] + CASE WHEN k > n + 1 THEN ways[k - n - 1] ELSE 0 END) FROM sn WHERE n < 50)"


def signed_rank_p(w: str, n: str, ties: str, zeros: str) -> str:
    """Exact without ties and zeros (a join with ``sn`` on n gives ``ways``), else normal with the correction for ties."""
    exact = f"least(1.0, 2 * least(list_sum(ways[1:CAST({w} AS INTEGER) + 1]), list_sum(ways[CAST({w} AS INTEGER) + 1:])) / list_sum(ways))"
    z = f"(({w} - {n} * ({n} + 1) / 4.0) / sqrt({n} * ({n} + 1) * (2 * {n} + 1) / 24.0 - {ties} / 48.0))"
    return f"CASE WHEN {n} = 0 THEN 1.0 WHEN {n} <= 50 AND {ties} = 0 AND {zeros} = 0 THEN {exact} ELSE {normal_p(z)} END"


def rank_sum_p(u: str, a: str, b: str, ties: str) -> str:
    """Normal with continuity and ties: for groups that are too large, or tied, for the exact null."""
    n = f"({a} + {b})"
    z = f"greatest(0.0, (greatest({u}, {a} * {b} - {u}) - {a} * {b} / 2.0 - 0.5) / sqrt({a} * {b} / 12.0 * ({n} + 1 - {ties} / ({n} * ({n} - 1.0)))))"
    return f"least(1.0, {normal_p(z)})"


def cox(name: str, source: str, terms: list[str], rounds: int = 8, by: str = "") -> str:
    """Common tables that end in ``name``: one row (for each ``by``) with b0.. (coefficients), v0.. (variances), ll and n,
    by Newton steps.

    ``source`` has time, event and ``terms``. Each step sums moments by time, runs them from the latest time on, and
    eliminates the unknowns of p equations with the unit matrix beside them.
    """
    p = len(terms)
    k = range(p)
    pairs = [(i, j) for i in k for j in range(i, p)]
    key, using, part, group = (f"{by}, ", f" JOIN {{}} USING ({by})", f"PARTITION BY {by} ", f" GROUP BY {by}") if by else ("", ", {}", "", "")
    out = [f"{name}_b0 AS MATERIALIZED (SELECT {'DISTINCT ' if by else ''}{key}{', '.join(f'0.0::DOUBLE AS b{i}' for i in k)}{f' FROM {source}' if by else ''})"]
    for r in range(rounds):
        eta = " + ".join(f"b{i} * {t}" for i, t in enumerate(terms))
        out.append(f"{name}_x{r} AS MATERIALIZED (SELECT {key}time, event, {', '.join(f'{t} AS z{i}' for i, t in enumerate(terms))}, {eta} AS eta FROM {source}{using.format(f'{name}_b{r}')})")
        sums = ["sum(event) AS d", "sum(event * eta) AS e", "sum(exp(eta)) AS s", *(f"sum(event * z{i}) AS g{i}" for i in k), *(f"sum(exp(eta) * z{i}) AS a{i}" for i in k), *(f"sum(exp(eta) * z{i} * z{j}) AS q{i}_{j}" for i, j in pairs)]
        out.append(f"{name}_t{r} AS MATERIALIZED (SELECT {key}time, count(*) AS c, {', '.join(sums)} FROM {name}_x{r} GROUP BY {key}time)")
        run = ["sum(s) OVER w AS s", *(f"sum(a{i}) OVER w AS a{i}" for i in k), *(f"sum(q{i}_{j}) OVER w AS q{i}_{j}" for i, j in pairs)]
        out.append(f"{name}_r{r} AS MATERIALIZED (SELECT {key}time, d, e, c, {', '.join(f'g{i}' for i in k)}, {', '.join(run)} FROM {name}_t{r} WINDOW w AS ({part}ORDER BY time DESC))")
        slope = [f"sum(CASE WHEN d > 0 THEN g{i} - d * a{i} / s END) AS m{i}_{2 * p}" for i in k]
        bend = [f"sum(CASE WHEN d > 0 THEN d * (q{min(i, j)}_{max(i, j)} / s - a{i} * a{j} / s / s) END) AS m{i}_{j}" for i in k for j in k]
        unit = [f"{1.0 if i == j else 0.0}::DOUBLE AS m{i}_{p + j}" for i in k for j in k]
        out.append(f"{name}_e{r}_0 AS MATERIALIZED (SELECT {key}sum(CASE WHEN d > 0 THEN e - d * ln(s) END) AS ll, sum(c) AS n, {', '.join(slope + bend + unit)} FROM {name}_r{r}{group})")
        for i in k:
            cells = []
            for row in k:
                for col in range(2 * p + 1):
                    pivot = f"m{i}_{col} / m{i}_{i}"
                    cells.append(f"{pivot if row == i else f'm{row}_{col} - m{row}_{i} * {pivot}'} AS m{row}_{col}")
            out.append(f"{name}_e{r}_{i + 1} AS MATERIALIZED (SELECT {key}ll, n, {', '.join(cells)} FROM {name}_e{r}_{i})")
        out.append(f"{name}_b{r + 1} AS MATERIALIZED (SELECT {key}{', '.join(f'b{i} + m{i}_{2 * p} AS b{i}' for i in k)} FROM {name}_b{r}{using.format(f'{name}_e{r}_{p}')})")
    last = rounds - 1
    out.append(f"{name} AS MATERIALIZED (SELECT {key}ll, n, {', '.join(f'b{i}, m{i}_{p + i} AS v{i}' for i in k)} FROM {name}_b{last}{using.format(f'{name}_e{last}_{p}')})")
    return ", ".join(out)

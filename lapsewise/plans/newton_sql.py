"""Comparison SQL for Cox fits with one or two covariates: Newton steps written out as CTEs."""

from __future__ import annotations


def newton(source: str, x: list[str], ties: str = "efron", steps: int = 8, late: bool = False) -> str:
    """CTEs that end in ``fit(b1[, b2], v11[, v22], loglik, loglik0)`` from a CTE ``source(t, [s,] e, x1[, x2])``."""
    p = len(x)
    cols = range(1, p + 1)
    pairs = [(i, j) for i in cols for j in cols if i <= j]
    frac = "l.l / g.d" if ties == "efron" else "0.0"
    out = ["b0 AS MATERIALIZED (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in cols) + ")"]

    def sums(w: str) -> str:
        parts = [f"sum({w}) AS {{0}}0"] + [f"sum({w} * x{i}) AS {{0}}{i}" for i in cols]
        parts += [f"sum({w} * x{i} * x{j}) AS {{0}}{i}{j}" for i, j in pairs]
        return ", ".join(parts)

    names = ["0", *map(str, cols), *(f"{i}{j}" for i, j in pairs)]
    for k in range(steps + 1):
        lp = " + ".join(f"b{i} * x{i}" for i in cols)
        out.append(f"r{k} AS MATERIALIZED (SELECT *, {lp} AS lp, exp({lp}) AS r FROM {source}, b{k})")
        rows = f"SELECT t, e, lp, r, r AS w, {', '.join(f'x{i}' for i in cols)} FROM r{k}"
        if late:
            rows += f" UNION ALL SELECT s, 0, 0, 0, -r, {', '.join(f'x{i}' for i in cols)} FROM r{k}"
        out.append(
            f"g{k} AS MATERIALIZED (SELECT t, CAST(sum(e) AS BIGINT) AS d, {sums('w').format('a')}, {sums('e * r').format('h')}, "
            + ", ".join(f"sum(e * x{i}) AS ex{i}" for i in cols) + f", sum(e * lp) AS elp FROM ({rows}) GROUP BY t)")
        # With late entry an entry at t counts as gone at t, so sums run over t and later for both.
        over = ", ".join(f"sum(a{n}) OVER (ORDER BY t DESC) AS s{n}" for n in names)
        out.append(f"c{k} AS MATERIALIZED (SELECT *, {over} FROM g{k})")
        den = f"(g.s0 - {frac} * g.h0)"
        means = ", ".join(f"(g.s{i} - {frac} * g.h{i}) / {den} AS m{i}" for i in cols)
        squares = ", ".join(f"(g.s{i}{j} - {frac} * g.h{i}{j}) / {den} AS q{i}{j}" for i, j in pairs)
        out.append(f"m{k} AS MATERIALIZED (SELECT ln({den}) AS ld, {means}, {squares} "
                   f"FROM c{k} g, LATERAL (SELECT unnest(range(g.d)) AS l) l WHERE g.d > 0)")
        tot = ", ".join([f"(SELECT sum(ex{i}) FROM g{k}) - sum(m{i}) AS u{i}" for i in cols]
                        + [f"sum(q{i}{j} - m{i} * m{j}) AS i{i}{j}" for i, j in pairs])
        out.append(f"n{k} AS MATERIALIZED (SELECT {tot}, (SELECT sum(elp) FROM g{k}) - sum(ld) AS loglik FROM m{k})")
        if p == 1:
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b1 + u1 / i11 AS b1 FROM b{k}, n{k})")
        else:
            det = "(i11 * i22 - i12 * i12)"
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b1 + (i22 * u1 - i12 * u2) / {det} AS b1, "
                       f"b2 + (i11 * u2 - i12 * u1) / {det} AS b2 FROM b{k}, n{k})")
    v = "1 / i11 AS v11" if p == 1 else "i22 / (i11 * i22 - i12 * i12) AS v11, i11 / (i11 * i22 - i12 * i12) AS v22"
    betas = ", ".join(f"b.b{i}" for i in cols)
    out.append(f"fit AS MATERIALIZED (SELECT {betas}, {v}, n.loglik AS loglik, z.loglik AS loglik0 "
               f"FROM b{steps} b, n{steps} n, (SELECT loglik FROM n0) z)")
    return ", ".join(out)


def penalised(source: str, lambdas: list[float], alpha: float, steps: int = 10) -> str:
    """CTEs that end in ``path(lambda, beta)``: proximal Newton steps with one covariate ``x1`` on unit scale, Breslow ties."""
    out = [f"sc AS MATERIALIZED (SELECT avg(x1) AS m, stddev_pop(x1) AS s, count(*) AS n FROM {source})",
           f"z AS MATERIALIZED (SELECT t, e, (x1 - m) / s AS x FROM {source}, sc)",
           "k0 AS MATERIALIZED (SELECT unnest([" + ", ".join(map(str, lambdas)) + "])::DOUBLE AS lam, CAST(0 AS DOUBLE) AS b)"]
    for k in range(steps):
        out.append(f"g{k} AS MATERIALIZED (SELECT lam, b, t, sum(e) AS d, sum(exp(b * x)) AS s0, sum(x * exp(b * x)) AS s1, "
                   f"sum(x * x * exp(b * x)) AS s2, sum(e * x) AS ex FROM z, k{k} GROUP BY lam, b, t)")
        over = ", ".join(f"sum(s{i}) OVER (PARTITION BY lam ORDER BY t DESC) AS r{i}" for i in range(3))
        out.append(f"c{k} AS MATERIALIZED (SELECT lam, b, d, ex, {over} FROM g{k})")
        out.append(f"u{k} AS MATERIALIZED (SELECT lam, b, 2 * sum(ex - d * r1 / r0) / any_value(n) AS u, "
                   f"2 * sum(d * (r2 / r0 - (r1 / r0) * (r1 / r0))) / any_value(n) AS i FROM c{k}, sc GROUP BY lam, b)")
        soft = f"sign(i * b + u) * greatest(abs(i * b + u) - lam * {alpha}, 0)"
        out.append(f"k{k + 1} AS MATERIALIZED (SELECT lam, {soft} / (i + lam * {1 - alpha}) AS b FROM u{k})")
    out.append(f'path AS (SELECT lam AS "lambda", b / s AS beta FROM k{steps}, sc)')
    return ", ".join(out)


def elastic_net(source: str, p: int, start: str, out: str, alpha: float, steps: int = 7, sweeps: int = 60) -> str:
    """CTEs that end in ``out(lam, skip, m1.., b1..)``: proximal Newton steps with ``p`` covariates, Breslow ties.

    ``source(t, e, f, x1..)`` has covariates on unit scale. Each row of ``start(lam, skip, m1..)`` is a fit of its own, which leaves out the
    rows of fold ``skip`` and keeps a coefficient at zero where its ``m`` is 0. Each quadratic problem is solved by sweeps over the coordinates.
    """
    cols = range(1, p + 1)
    pairs = [(i, j) for i in cols for j in cols if i <= j]
    lane = "lam, skip, " + ", ".join(f"m{i}, b{i}" for i in cols)
    curve = {(i, j): f"q{min(i, j)}{max(i, j)}" for i in cols for j in cols}
    ctes = [f"{out}_n AS MATERIALIZED (SELECT skip, count(*) AS n FROM {source} JOIN (SELECT DISTINCT skip FROM {start}) ON f <> skip GROUP BY skip)",
            f"{out}_0 AS MATERIALIZED (SELECT lam, skip, " + ", ".join(f"m{i}, CAST(0 AS DOUBLE) AS b{i}" for i in cols) + f" FROM {start})"]
    for k in range(steps):
        lp = " + ".join(f"b{i} * x{i}" for i in cols)
        sums = ["sum(e) AS d", "sum(r) AS s0"] + [f"sum(r * x{i}) AS s{i}" for i in cols] + [f"sum(r * x{i} * x{j}) AS s{i}{j}" for i, j in pairs]
        sums += [f"sum(e * x{i}) AS ex{i}" for i in cols]
        ctes.append(f"{out}_g{k} AS MATERIALIZED (SELECT {lane}, t, {', '.join(sums)} FROM (SELECT *, exp({lp}) AS r FROM {source} JOIN {out}_{k} ON f <> skip) "
                    f"GROUP BY {lane}, t)")
        names = ["0", *map(str, cols), *(f"{i}{j}" for i, j in pairs)]
        over = ", ".join(f"sum(s{a}) OVER (PARTITION BY lam, skip ORDER BY t DESC) AS r{a}" for a in names)
        ctes.append(f"{out}_c{k} AS MATERIALIZED (SELECT *, {over} FROM {out}_g{k})")
        parts = [f"2 * sum(ex{i} - d * r{i} / r0) / any_value(n) AS u{i}" for i in cols]
        parts += [f"2 * sum(d * (r{i}{j} / r0 - (r{i} / r0) * (r{j} / r0))) / any_value(n) AS q{i}{j}" for i, j in pairs]
        ctes.append(f"{out}_u{k} AS MATERIALIZED (SELECT {lane}, {', '.join(parts)} FROM {out}_c{k} JOIN {out}_n USING (skip) GROUP BY {lane})")
        fixed = "lam, skip, " + ", ".join([f"m{i}" for i in cols] + [f"o{i}" for i in cols] + [f"u{i}" for i in cols] + [f"q{i}{j}" for i, j in pairs])
        sweep = f"(SELECT turn + 1 AS turn, {fixed}, {', '.join(f'b{i}' for i in cols)} FROM it WHERE turn < {sweeps})"
        for j in cols:
            z = f"(u{j} + q{j}{j} * b{j} - (" + " + ".join(f"{curve[j, i]} * (b{i} - o{i})" for i in cols) + "))"
            new = f"m{j} * sign({z}) * greatest(abs({z}) - lam * {alpha}, 0) / (q{j}{j} + lam * {1 - alpha}) AS b{j}"
            sweep = f"(SELECT turn, {fixed}, {', '.join(new if i == j else f'b{i}' for i in cols)} FROM {sweep})"
        first = "SELECT 0, lam, skip, " + ", ".join([f"m{i}" for i in cols] + [f"b{i}" for i in cols] + [f"u{i}" for i in cols]
                                                   + [f"q{i}{j}" for i, j in pairs] + [f"b{i}" for i in cols]) + f" FROM {out}_u{k}"
        ctes.append(f"{out}_{k + 1} AS MATERIALIZED (WITH RECURSIVE it(turn, {fixed}, {', '.join(f'b{i}' for i in cols)}) AS ({first} UNION ALL SELECT * FROM {sweep}) "
                    f"SELECT {lane} FROM it WHERE turn = {sweeps})")
    ctes.append(f"{out} AS MATERIALIZED (SELECT * FROM {out}_{steps})")
    return ", ".join(ctes)


def unit_scale(raw: str, p: int, folds: int, n_lambda: int, min_ratio: float, alpha: float) -> str:
    """CTEs ``sc`` (deviations), ``z`` (covariates on unit scale) and ``lanes``: all rows, and all but each fold, at each lambda of the automatic grid."""
    cols = range(1, p + 1)
    moments = ", ".join(f"avg(x{i}) AS mu{i}, stddev_pop(x{i}) AS sd{i}" for i in cols)
    zero = ", ".join(f"abs(sum(ex{i} - d * r{i} / r0)) AS u{i}" for i in cols)
    sums = ", ".join(f"sum(x{i}) AS s{i}, sum(e * x{i}) AS ex{i}" for i in cols)
    over = ", ".join(f"sum(s{i}) OVER (ORDER BY t DESC) AS r{i}" for i in cols)
    return f"""sc AS MATERIALIZED (SELECT count(*) AS n, {moments} FROM {raw}),
 z AS MATERIALIZED (SELECT t, e, f, {', '.join(f'(x{i} - mu{i}) / sd{i} AS x{i}' for i in cols)} FROM {raw}, sc),
 zg AS (SELECT t, sum(e) AS d, count(*) AS n0, {sums} FROM z GROUP BY t), zc AS (SELECT *, sum(n0) OVER (ORDER BY t DESC) AS r0, {over} FROM zg),
 top AS MATERIALIZED (SELECT 2 * greatest({', '.join(f'u{i}' for i in cols)}) / n / {alpha} AS top FROM (SELECT {zero} FROM zc), sc),
 lanes AS MATERIALIZED (SELECT top * pow({min_ratio}, i / {n_lambda - 1}.0::DOUBLE) AS lam, CAST(skip AS INTEGER) AS skip, {', '.join(f'1 AS m{i}' for i in cols)}
   FROM top, range({n_lambda}) l(i), (SELECT -2 AS skip UNION ALL SELECT * FROM range({folds})))"""


def deviance_cv(source: str, fits: str, p: int) -> str:
    """CTEs that end in ``cv(lam, mean, se)`` and ``chosen(rule, lam)``: deviance per held-out event of the fits that leave out a fold."""
    lp = " + ".join(f"b{i} * x{i}" for i in range(1, p + 1))
    return f"""vg AS MATERIALIZED (SELECT lam, skip, t, sum(e) AS d, sum(r) AS s, sum(e * lp) AS el, sum(e) FILTER (f <> skip) AS dt,
   coalesce(sum(r) FILTER (f <> skip), 0) AS st, sum(e * lp) FILTER (f <> skip) AS et
   FROM (SELECT *, exp(lp) AS r FROM (SELECT *, {lp} AS lp FROM {source}, {fits} WHERE skip >= 0)) GROUP BY lam, skip, t),
 vc AS (SELECT *, sum(s) OVER w AS r0, sum(st) OVER w AS rt FROM vg WINDOW w AS (PARTITION BY lam, skip ORDER BY t DESC)),
 vl AS (SELECT lam, skip, sum(el) - sum(d * ln(r0)) AS whole, sum(et) - sum(CASE WHEN dt > 0 THEN dt * ln(rt) ELSE 0 END) AS part, sum(d) - sum(dt) AS w FROM vc GROUP BY lam, skip),
 vr AS (SELECT lam, w, -2 * (whole - part) / w AS raw FROM vl),
 vm AS (SELECT lam, sum(w * raw) / sum(w) AS mean FROM vr GROUP BY lam),
 cv AS MATERIALIZED (SELECT lam, any_value(mean) AS mean, sqrt(sum(w * (raw - mean) * (raw - mean)) / sum(w) / (count(*) - 1)) AS se FROM vr JOIN vm USING (lam) GROUP BY lam),
 best AS (SELECT lam, mean, se FROM cv ORDER BY round(mean, 9), lam DESC LIMIT 1),
 chosen AS MATERIALIZED (SELECT 'lambda.min' AS rule, lam FROM best UNION ALL
   SELECT 'lambda.1se', max(cv.lam) FROM cv, best WHERE cv.mean <= best.mean + best.se)"""


def concordance_cv(source: str, fits: str, p: int) -> str:
    """CTEs that end in ``cv(lam, mean, se)`` and ``chosen(rule, lam)``: concordance of each held-out fold, pairs counted between distinct covariates."""
    xs, cols = ", ".join(f"x{i}" for i in range(1, p + 1)), range(1, p + 1)
    lp = " + ".join(f"b{i} * x{i}" for i in cols)
    return f"""kinds AS MATERIALIZED (SELECT f, {xs}, row_number() OVER () AS c FROM (SELECT DISTINCT f, {xs} FROM {source})),
 cells AS MATERIALIZED (SELECT f, c, t, e, count(*) AS n FROM {source} JOIN kinds USING (f, {xs}) GROUP BY ALL),
 met AS MATERIALIZED (SELECT a.f, a.c AS ca, b.c AS cb, sum(a.n * b.n) AS w
   FROM cells a JOIN cells b ON a.f = b.f AND a.e = 1 AND (b.t > a.t OR b.t = a.t AND b.e = 0) GROUP BY ALL),
 lps AS MATERIALIZED (SELECT lam, f, c, {lp} AS lp FROM kinds JOIN {fits} ON skip = f),
 vr AS (SELECT a.lam, met.f, sum(met.w * CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END) / sum(met.w) AS raw
   FROM met JOIN lps a ON a.c = ca JOIN lps b ON b.c = cb AND a.lam = b.lam GROUP BY ALL),
 vs AS (SELECT lam, raw, n AS w FROM vr JOIN (SELECT f, count(*) AS n FROM {source} GROUP BY f) USING (f)),
 vm AS (SELECT lam, sum(w * raw) / sum(w) AS mean FROM vs GROUP BY lam),
 cv AS MATERIALIZED (SELECT lam, any_value(mean) AS mean, sqrt(sum(w * (raw - mean) * (raw - mean)) / sum(w) / (count(*) - 1)) AS se FROM vs JOIN vm USING (lam) GROUP BY lam),
 best AS (SELECT lam, mean, se FROM cv ORDER BY round(mean, 9) DESC, lam DESC LIMIT 1),
 chosen AS MATERIALIZED (SELECT 'lambda.min' AS rule, lam FROM best UNION ALL
   SELECT 'lambda.1se', max(cv.lam) FROM cv, best WHERE cv.mean >= best.mean - best.se)"""

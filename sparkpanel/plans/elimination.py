"""Regressions in SQL: sums of products as rows (keys, i, j, v), and one table for each eliminated regressor."""

from __future__ import annotations


def gram_sql(keys: str, vector: str, source: str) -> str:
    """keys, i, j, v from a source with a list of regressors, the target last."""
    return f"SELECT {keys}, i, j, sum(({vector})[i + 1] * ({vector})[j + 1]) AS v FROM ({source}), range(0, len({vector})) a(i), range(0, len({vector})) b(j) GROUP BY ALL"


def elimination_sql(name: str, keys: list[str], start: int, stop: int) -> list[str]:
    """Tables name_{k + 1}: name_k without regressor k; a regressor that has nothing of its own is passed over."""
    same = lambda x: " AND ".join(f"a.{k} = {x}.{k}" for k in keys)
    out = []
    for k in range(start, stop):
        n = f"{name}_{k}"
        out.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT {', '.join('a.' + x for x in keys)}, a.i, a.j, a.v - CASE WHEN p.v > 1e-9 THEN b.v * c.v / p.v ELSE 0 END AS v FROM {n} a JOIN {n} b ON {same('b')} AND b.i = a.i AND b.j = {k}"
            f" JOIN {n} c ON {same('c')} AND c.i = {k} AND c.j = a.j JOIN {n} p ON {same('p')} AND p.i = {k} AND p.j = {k} WHERE a.i > {k} AND a.j > {k})"
        )
    return out


def granger_sql(series: str, most: int = 4) -> str:
    """Tables up to granger_p (feature, sector, lag, stat, bottom); series: feature, sector, t, value, y without holes."""
    d = f"""gd AS MATERIALIZED (SELECT feature, sector, t, y - lag(y) OVER o AS dy, value - lag(value) OVER o AS dx FROM ({series}) WINDOW o AS (PARTITION BY feature, sector ORDER BY t)),
ge AS MATERIALIZED (SELECT *, {', '.join(f'lag({c}, {k}) OVER o AS {c}{k}' for c in ('dy', 'dx') for k in range(1, most + 1))}, row_number() OVER o AS line, count(*) OVER (PARTITION BY feature, sector) AS n_all, max(dx) OVER (PARTITION BY feature, sector) - min(dx) OVER (PARTITION BY feature, sector) AS width
FROM gd WHERE dy IS NOT NULL WINDOW o AS (PARTITION BY feature, sector ORDER BY t)),
gr AS MATERIALIZED (SELECT feature, sector, lag, [1.0::DOUBLE, {', '.join(f'CASE WHEN lag >= {k} THEN {c}{k} ELSE 0 END' for c in ('dy', 'dx') for k in range(1, most + 1))}, dy] AS x FROM ge, range(1, {most + 1}) r(lag) WHERE n_all >= {3 * most} AND width > 0 AND line > lag)"""
    keys, size = ["feature", "sector", "lag"], 2 * most + 2
    tables = [d, f"gm_0 AS MATERIALIZED ({gram_sql(', '.join(keys), 'x', 'SELECT * FROM gr')})", *elimination_sql("gm", keys, 0, size - 1)]
    n = "SELECT feature, sector, lag, count(*) AS n FROM gr GROUP BY ALL"
    tables.append(f"""granger_p AS MATERIALIZED (SELECT feature, sector, lag, greatest(0, a.v - b.v) / lag / (b.v / (n - 2 * lag - 1)) AS stat, (n - 2 * lag - 1)::DOUBLE AS bottom
FROM (SELECT * FROM gm_{most + 1} WHERE i = {size - 1} AND j = {size - 1}) a JOIN (SELECT * FROM gm_{size - 1} WHERE i = {size - 1} AND j = {size - 1}) b USING (feature, sector, lag) JOIN ({n}) USING (feature, sector, lag) WHERE n > 2 * lag + 1)""")
    return ",\n".join(tables)


def adf_sql(series: str, most: int = 9) -> str:
    """Tables up to adf (sector, statistic, lags, critical, stationary); series: sector, t, y without holes, of up to 31 values."""
    size, key = most + 3, ["sector"]
    lags = ", ".join(f"lag(dy, {k}) OVER o AS l{k}" for k in range(1, most + 1))
    vector = lambda limit: ", ".join(f"CASE WHEN {limit} >= {k} THEN l{k} ELSE 0 END" for k in range(1, most + 1))
    left = " UNION ALL ".join(f"SELECT sector, {k} AS k, v FROM am_{k + 2} WHERE i = {size - 1} AND j = {size - 1}" for k in range(most + 1))
    at = lambda i, j: f"max(v) FILTER (i = {i} AND j = {j})"
    level, target = size - 2, size - 1
    return ",\n".join([
        f"""ad AS MATERIALIZED (SELECT sector, t, y, lag(y) OVER o AS level, y - lag(y) OVER o AS dy, row_number() OVER o - 2 AS line, count(*) OVER (PARTITION BY sector) AS n_all FROM ({series}) WINDOW o AS (PARTITION BY sector ORDER BY t)),
al AS MATERIALIZED (SELECT *, {lags}, least(ceil(12 * (n_all / 100.0::DOUBLE) ** 0.25), greatest(0, n_all // 2 - 2))::INT AS most FROM ad WHERE n_all >= 10 WINDOW o AS (PARTITION BY sector ORDER BY t)),
ax AS MATERIALIZED (SELECT sector, [1.0::DOUBLE, level, {vector('most')}, dy] AS x FROM al WHERE dy IS NOT NULL AND line >= most)""",
        f"am_0 AS MATERIALIZED ({gram_sql('sector', 'x', 'SELECT * FROM ax')})", *elimination_sql("am", key, 0, size - 1),
        f"""ak AS MATERIALIZED (SELECT sector, min_by(k, (round(n * ln(greatest(v, 1e-300) / n) + 2 * (k + 2), 9), k)) AS lags FROM ({left}) JOIN (SELECT sector, count(*) AS n, max(most) AS most FROM al WHERE line >= most AND dy IS NOT NULL GROUP BY 1) USING (sector) WHERE k <= most GROUP BY 1),
ay AS MATERIALIZED (SELECT sector, lags, [1.0::DOUBLE, {vector('lags')}, level, dy] AS x FROM al JOIN ak USING (sector) WHERE dy IS NOT NULL AND line >= lags)""",
        f"an_0 AS MATERIALIZED ({gram_sql('sector', 'x', 'SELECT * FROM ay')})", *elimination_sql("an", key, 0, size - 2),
        f"""af AS (SELECT sector, {at(level, level)} AS s, {at(level, target)} AS c, {at(target, target)} AS w FROM an_{size - 2} GROUP BY 1),
adf AS MATERIALIZED (SELECT sector, c / s / sqrt((w - c * c / s) / (n - lags - 2) / s) AS statistic, lags, -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS critical FROM af JOIN (SELECT sector, lags, count(*)::DOUBLE AS n FROM ay GROUP BY ALL) USING (sector))""",
    ])

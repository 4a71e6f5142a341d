"""Plain SQL of the fitted models, step by step: k-means with its start and rounds, and the normal equations of the regression."""

from __future__ import annotations

from collections.abc import Sequence


def kmeans_sql(source: str, names: Sequence[str], k: int, seed: int = 11, observed: bool = True, rounds: int = 20) -> str:
    """One row per customer: customer_id, observed_30d, centroid_id, distance, center (of its centroid, as a list), x (standardised features)."""
    p = len(names)
    train = f"(SELECT * FROM {source} WHERE observed_30d)" if observed else source
    scaled = ", ".join(f"coalesce(({n}::DOUBLE - m{j}) * CASE WHEN s{j} > 0 THEN 1 / s{j} ELSE 0 END, 0)" for j, n in enumerate(names))
    race = lambda step: f"-ln((('0x' || substr(md5('{seed}:{step}:' || customer_id), 1, 13))::BIGINT + 1)::DOUBLE / (16::DOUBLE ** 13 + 1))"
    steps = [
        "stat AS MATERIALIZED (SELECT " + ", ".join(f"avg({n}::DOUBLE) AS m{j}, stddev_samp({n}::DOUBLE) AS s{j}" for j, n in enumerate(names)) + f" FROM {train} t)",
        f"z AS MATERIALIZED (SELECT customer_id, observed_30d, [{scaled}] AS x FROM {source}, stat)",
        f"t AS MATERIALIZED (SELECT * FROM z{' WHERE observed_30d' if observed else ''})",
        f"k0 AS MATERIALIZED (SELECT 1 AS cid, x AS c FROM t ORDER BY {race(0)}, customer_id LIMIT 1)",
    ]
    for i in range(1, k):
        gap = "SELECT customer_id, any_value(x) AS x, min(list_distance(x, c)) ** 2 AS d2 FROM t, k" + str(i - 1) + " GROUP BY customer_id"
        steps.append(f"k{i} AS MATERIALIZED (FROM k{i - 1} UNION ALL SELECT * FROM (SELECT {i + 1}, x FROM ({gap}) WHERE d2 > 0 ORDER BY {race(i)} / d2, customer_id LIMIT 1))")
    now = f"k{k - 1}"
    near = "SELECT customer_id, observed_30d, x, cid, c, d FROM (SELECT *, list_distance(x, c) AS d FROM {rows}, {centers}) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY d, cid) = 1"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(rows='t', centers=now)})")
        steps.append(f"c{r} AS MATERIALIZED (SELECT cid, list(m ORDER BY j) AS c FROM (SELECT cid, j, avg(x[j]) AS m FROM a{r}, (SELECT unnest(range(1, {p + 1})) AS j) GROUP BY ALL) GROUP BY cid "
                     f"UNION ALL SELECT cid, c FROM {now} WHERE cid NOT IN (SELECT cid FROM a{r}))")
        now = f"c{r}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT customer_id, observed_30d, cid AS centroid_id, d AS distance, c AS center, x FROM ({near.format(rows='z', centers=now)})"


def ridge_sql(source: str, cats: Sequence[str], amounts: Sequence[str], ridge: float) -> str:
    """All columns of ``source`` and ``predicted``: fitted on its training rows, by elimination on the matrix of standardised inputs."""
    none = lambda c: f"coalesce({c}, '(none)')"
    inputs = " UNION ALL ".join([f"SELECT customer_id, '{c}=' || {none(c)} AS term, 1::DOUBLE AS v FROM s" for c in cats]
                                + [f"SELECT customer_id, '{c}', coalesce({c}::DOUBLE, (SELECT avg({c}::DOUBLE) FROM tr)) FROM s" for c in amounts])
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {source}),
    tr AS MATERIALIZED (SELECT customer_id, future_revenue_30d::DOUBLE AS y, {', '.join(amounts)} FROM s WHERE label_complete AND NOT is_eval),
    x AS MATERIALIZED ({inputs}),
    n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(y) AS my, stddev_pop(y) AS sy FROM tr),
    tx AS MATERIALIZED (SELECT term, v, customer_id, y FROM x JOIN tr USING (customer_id)),
    st AS MATERIALIZED (SELECT term, m, sqrt(q - m * m) AS dev, xy FROM (SELECT term, sum(v) / n AS m, sum(v * v) / n AS q, sum(v * y) / n AS xy FROM tx, n GROUP BY term, n) WHERE q - m * m > 0),
    num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY term) AS i FROM st),
    prod AS MATERIALIZED (SELECT a.term AS ta, b.term AS tb, sum(a.v * b.v) / any_value(n) AS q FROM tx a JOIN tx b USING (customer_id), n GROUP BY ALL),
    grid AS MATERIALIZED (SELECT a.i, b.i AS j, (coalesce(q, 0) - a.m * b.m) / (a.dev * b.dev) + CASE WHEN a.i = b.i THEN {ridge} ELSE 0 END AS e
        FROM num a CROSS JOIN num b LEFT JOIN prod ON ta = a.term AND tb = b.term
        UNION ALL SELECT i, 1000000, (xy - m * my) / (dev * sy) FROM num, n),
    lines AS MATERIALIZED (SELECT i, list(e ORDER BY j) AS r FROM grid GROUP BY i),
    gauss AS (SELECT 1 AS k, list(r ORDER BY i) AS mat FROM lines
        UNION ALL SELECT k + 1, list_transform(mat, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda e: e / row[k])
            ELSE list_transform(row, lambda e, j: e - row[k] / mat[k][k] * mat[k][j]) END) FROM gauss WHERE k <= len(mat)),
    done AS MATERIALIZED (SELECT mat FROM gauss WHERE k = len(mat) + 1),
    coef AS MATERIALIZED (SELECT term, m, mat[i][len(mat) + 1] * sy / dev AS w FROM num, done, n),
    base AS MATERIALIZED (SELECT any_value(my) - sum(w * m) AS b FROM coef, n),
    fit AS MATERIALIZED (SELECT customer_id, sum(w * v) AS p FROM x JOIN coef USING (term) GROUP BY customer_id)
    SELECT s.*, b + coalesce(p, 0) AS predicted FROM s LEFT JOIN fit USING (customer_id), base"""

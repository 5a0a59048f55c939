"""Building blocks of the SQL twins: shared common table expressions and generators."""

from __future__ import annotations

MOB = ["retail_recreation", "grocery_pharmacy", "parks", "transit", "workplaces", "residential"]
WX = ["temperature_mean", "precipitation", "humidity_mean"]
_FLAGS = [("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")]

_SUPPLIED = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
_ORDERED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(cols: list[str], digits: int = 6) -> str:
    return ", ".join(r(c, digits=digits) for c in cols)


def over(part: str = "", frame: str = "", order: str = "date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"OVER ({p}ORDER BY {order} {frame})".replace(" )", ")")


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FROM = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def last_k(k: int) -> str:
    return f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"


def fill_sql(src: str, keep: list[str], cols: list[str], part: str = "", order: str = "date", how: str = "both") -> str:
    def one(c: str) -> str:
        prev = f"last_value({c} IGNORE NULLS) {over(part, UPTO, order)}"
        nxt = f"first_value({c} IGNORE NULLS) {over(part, FROM, order)}"
        sides = {"both": [prev, nxt], "ffill": [prev], "bfill": [nxt]}[how]
        return f"coalesce({', '.join(sides)}) AS {c}"

    return f"SELECT {', '.join(keep + [one(c) for c in cols])} FROM {src}"


def interp_sql(src: str, keep: list[str], cols: list[str], part: str = "", order: str = "date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    near, out = [], []
    for c in cols:
        at = f"CASE WHEN {c} IS NOT NULL THEN pos END"
        near += [
            f"last_value({c} IGNORE NULLS) {over(part, UPTO, 'pos')} AS pv_{c}",
            f"last_value({at} IGNORE NULLS) {over(part, UPTO, 'pos')} AS pp_{c}",
            f"first_value({c} IGNORE NULLS) {over(part, FROM, 'pos')} AS nv_{c}",
            f"first_value({at} IGNORE NULLS) {over(part, FROM, 'pos')} AS np_{c}",
        ]
        line = f"pv_{c} + (nv_{c} - pv_{c}) * ((pos - pp_{c})::DOUBLE / nullif(np_{c} - pp_{c}, 0))"
        out.append(f"coalesce({c}, {line}, pv_{c}, nv_{c})::DOUBLE AS {c}")
    return (
        f"SELECT {', '.join(keep + out)} FROM (SELECT *, {', '.join(near)} FROM "
        f"(SELECT *, row_number() OVER ({p}ORDER BY {order}) - 1 AS pos FROM {src}))"
    )


def pct_sql(cur: str, prev: str) -> str:
    return (
        f"CASE WHEN {prev} = 0 THEN CASE WHEN {cur} > 0 THEN 'Infinity'::DOUBLE "
        f"WHEN {cur} < 0 THEN '-Infinity'::DOUBLE END ELSE {cur} / {prev} - 1 END"
    )


def clip_sql(expr: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {expr} < {lo} THEN {lo} WHEN {expr} > {hi} THEN {hi} ELSE {expr} END"


def corr_sql(x: str, y: str) -> str:
    ok = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) {ok} * stddev_samp({y}) {ok}, 0)"


def rows_sql(items: list[dict[str, str]]) -> str:
    """One output row per dict of SQL expressions, from a one-row aggregate."""
    parts = ["{" + ", ".join(f"'{k}': {v}" for k, v in d.items()) + "}" for d in items]
    return f"unnest([{', '.join(parts)}], recursive := true)"


_mob = ", ".join(
    f"avg(l_quantity) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}') AS {n}" for n, (f, s) in zip(MOB, _FLAGS)
)
_raw_mob = ", ".join(
    f"CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity END AS {n}" for n, (f, s) in zip(MOB, _FLAGS)
)
_wx = (
    "avg(l_quantity) AS temperature_mean, sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS precipitation, "
    "(sum(round(l_tax * 100)::BIGINT) * 10)::DOUBLE / count(*) AS humidity_mean"
)
_totals = "CAST(sum(new_cases) OVER ({p}ORDER BY date) AS BIGINT) AS confirmed, CAST(sum(new_deaths) OVER ({p}ORDER BY date) AS BIGINT) AS deaths"
_line = "l_suppkey, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey"

CTES: dict[str, tuple[list[str], str]] = {
    "daily": ([], "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS new_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS new_deaths FROM orders GROUP BY 1"),
    "cases": (["daily"], "SELECT *, " + _totals.format(p="") + " FROM daily"),
    "state_daily": ([], f"SELECT n_name AS state, CAST(o_orderdate AS DATE) AS date, count(*) AS new_cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS new_deaths FROM {_ORDERED} GROUP BY 1, 2"),
    "state_cases": (["state_daily"], "SELECT *, " + _totals.format(p="PARTITION BY state ") + " FROM state_daily"),
    "raw_daily": ([], "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1"),
    "raw_cases": (["raw_daily"], "SELECT date, CASE WHEN total % 5 = 0 THEN NULL ELSE total - 3 * p END AS new_cases, CASE WHEN total % 4 = 0 THEN NULL ELSE f - p END AS new_deaths, CAST(sum(total) OVER (ORDER BY date) AS BIGINT) AS confirmed, CAST(sum(f) OVER (ORDER BY date) AS BIGINT) AS deaths FROM raw_daily"),
    "mobility": ([], f"SELECT n_name AS state, CAST(l_shipdate AS DATE) AS date, {_mob} FROM {_SUPPLIED} GROUP BY 1, 2"),
    "raw_mobility": ([], f"SELECT n_name AS state, CAST(l_shipdate AS DATE) AS date, {_raw_mob} FROM {_SUPPLIED}"),
    "weather": ([], f"SELECT n_name AS state, CAST(l_shipdate AS DATE) AS date, {_wx} FROM {_SUPPLIED} GROUP BY 1, 2"),
    "raw_weather": ([], f"SELECT state, date, CASE WHEN k % 5 = 0 THEN NULL ELSE temperature_mean END AS temperature_mean, CASE WHEN k % 4 = 0 THEN NULL ELSE precipitation END AS precipitation, CASE WHEN k % 3 = 0 THEN NULL ELSE humidity_mean END AS humidity_mean FROM (SELECT n_name AS state, CAST(l_shipdate AS DATE) AS date, {_wx}, sum(l_linenumber)::BIGINT AS k FROM {_SUPPLIED} GROUP BY 1, 2)"),
    "demo": ([], "SELECT n_name AS state, count(*)::DOUBLE AS population_millions FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "share": (["demo"], "SELECT state, population_millions, population_millions / (SELECT sum(population_millions) FROM demo) AS pop_proportion FROM demo"),
    "mob_nat": (["mobility"], "SELECT date, " + ", ".join(f"avg({c}) AS {c}" for c in MOB) + " FROM mobility GROUP BY 1"),
    "mob_row": (["raw_mobility"], "SELECT date, " + ", ".join(f"avg({c}) AS {c}" for c in MOB) + " FROM raw_mobility GROUP BY 1"),
    "wx_nat": (["weather"], "SELECT date, " + ", ".join(f"avg({c}) AS {c}" for c in WX) + " FROM weather GROUP BY 1"),
    "inner_merged": (["cases", "mob_nat"], "SELECT * FROM cases JOIN mob_nat USING (date)"),
    "panel": (["state_cases", "mobility", "weather"], "SELECT * FROM state_cases LEFT JOIN mobility USING (state, date) LEFT JOIN weather USING (state, date)"),
    "split": (["cases"], "SELECT *, CASE WHEN pos >= tf THEN 'test' WHEN pos >= floor(tf * (1 - 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS role FROM (SELECT *, floor(n * (1 - 0.15::DOUBLE)) AS tf FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM cases))"),
    "test": (["split"], "SELECT date, new_cases FROM split WHERE role = 'test'"),
    "base": (["test"], f"SELECT date, new_cases::DOUBLE AS y_true, coalesce(first_value(naive IGNORE NULLS) {over('', FROM)}, 0)::DOUBLE AS naive, coalesce(first_value(seasonal IGNORE NULLS) {over('', FROM)}, 0)::DOUBLE AS seasonal, ma7 FROM (SELECT *, lag(new_cases, 1) OVER (ORDER BY date) AS naive, lag(new_cases, 7) OVER (ORDER BY date) AS seasonal, avg(new_cases) {over('', last_k(7))} AS ma7 FROM test)"),
    "preds": (["base"], "SELECT date, 'naive' AS model, y_true, naive AS y_pred FROM base UNION ALL SELECT date, 'seasonal', y_true, seasonal FROM base UNION ALL SELECT date, 'ma7', y_true, ma7 FROM base"),
    "state_split": (["state_cases"], "SELECT *, CASE WHEN pos >= tf THEN 'test' WHEN pos >= floor(tf * (1 - 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS role FROM (SELECT *, floor(n * (1 - 0.2::DOUBLE)) AS tf FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY state) AS n FROM state_cases))"),
    "state_base": (["state_split"], f"SELECT state, date, new_cases::DOUBLE AS y_true, coalesce(first_value(naive IGNORE NULLS) {over('state', FROM)}, 0)::DOUBLE AS naive, coalesce(first_value(seasonal IGNORE NULLS) {over('state', FROM)}, 0)::DOUBLE AS seasonal, ma7 FROM (SELECT *, lag(new_cases, 1) {over('state')} AS naive, lag(new_cases, 7) {over('state')} AS seasonal, avg(new_cases) {over('state', last_k(7))} AS ma7 FROM state_split WHERE role = 'test')"),
    "state_preds": (["state_base"], "SELECT state, date, 'naive' AS model, y_true, naive AS y_pred FROM state_base UNION ALL SELECT state, date, 'seasonal', y_true, seasonal FROM state_base UNION ALL SELECT state, date, 'ma7', y_true, ma7 FROM state_base"),
    "lines": ([], f"SELECT {_line}, l_quantity, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS gappy FROM lineitem"),
    "weights": (["preds"], "SELECT model, (1 / e) / sum(1 / e) OVER () AS weight FROM (SELECT model, greatest(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 1e-8) AS e FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM preds) WHERE k <= 14 GROUP BY 1)"),
    "ens": (["preds", "weights"], "SELECT date, 'ensemble' AS model, max(y_true) AS y_true, sum(weight * y_pred) AS y_pred FROM preds JOIN weights USING (model) GROUP BY date"),
}
LINE_ORDER = "date, l_orderkey, l_linenumber, l_partkey"


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named expressions and everything they need; ``extra`` come last."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = CTES[name]
        for n in needs:
            add(n)
        done[name] = text

    for n in names:
        add(n)
    done |= extra or {}
    if not done:
        return body
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in done.items()) + " " + body


def metrics_sql(src: str, by: list[str], part: list[str], y: str = "y_true") -> str:
    """The five accuracy metrics; ``y`` may be NULL where a pair does not exist."""
    p = ", ".join(part)
    hit = f"(sign({y} - lag({y}) OVER w) = sign(y_pred - lag(y_pred) OVER w))::INT::DOUBLE"
    keys = ", ".join(by)
    sse, sst = f"sum(({y} - y_pred) * ({y} - y_pred))", f"var_pop({y}) * count({y})"
    return (
        f"SELECT {keys}, {r(f'avg(abs({y} - y_pred))', 'mae')}, {r(f'sqrt(avg(({y} - y_pred) * ({y} - y_pred)))', 'rmse')}, "
        f"{r(f'avg(abs(({y} - y_pred) / nullif({y}, 0))) * 100', 'mape')}, {r('avg(hit) * 100', 'mda')}, "
        f"{r(f'CASE WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1 - {sse} / nullif({sst}, 0) END', 'r2')} FROM (SELECT *, {hit} AS hit FROM {src} WINDOW w AS (PARTITION BY {p} ORDER BY date)) GROUP BY {keys}"
    )

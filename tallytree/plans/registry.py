"""Registered queries, and for each the SQL that recomputes it from the tables alone."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import statistics
from ..operators import constraints, estimate, histogram, noise, synthesis
from ..sources import read_records
from . import frames
from .engine import TopDown
from .frames import CUSTOMERS, LABELLED, LINEITEMS, LINES, ORDERS, SPARSE, USERS, Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return register


# --- SQL of the oracles ----------------------------------------------------------------------------------


def _list(columns, prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in columns)


def _domain_sql(f: Frame) -> str:
    values = " CROSS JOIN ".join(f"(SELECT DISTINCT {q} FROM rec WHERE {q} IS NOT NULL)" for q in f.queries)
    return f"rec AS ({f.oracle}), dom AS (SELECT CAST(row_number() OVER (ORDER BY {_list(f.queries)}) - 1 AS INTEGER) AS cell_id, * FROM (SELECT {_list(f.queries)} FROM {values}))"


def _levels_sql(f: Frame) -> str:
    """lev0, lev1, ...: (path, cell_id, n) of all nodes and cells."""
    out = [_domain_sql(f)]
    for k in range(len(f.hierarchy) + 1):
        path = f.hierarchy[:k]
        nodes = f"(SELECT DISTINCT {_list(path)} FROM rec)" if path else "(SELECT 1 AS one)"
        on = " AND ".join([*(f"g.{p} = c.{p}" for p in path), "dom.cell_id = c.cell_id"])
        counts = f"(SELECT {_list(path, 'r.')}{', ' if path else ''}dom.cell_id, count(*) AS n FROM rec r JOIN dom USING ({_list(f.queries)}) GROUP BY ALL)"
        out.append(f"lev{k} AS (SELECT {_list(path, 'g.')}{', ' if path else ''}dom.cell_id, coalesce(c.n, 0) AS n FROM {nodes} g CROSS JOIN dom LEFT JOIN {counts} c ON {on})")
    return ", ".join(out)


def _stack_sql(f: Frame, relation: str, columns: str) -> str:
    def one(k: int) -> str:
        path = ", ".join(h if j < k else f"NULL AS {h}" for j, h in enumerate(f.hierarchy))
        return f"SELECT CAST({k} AS INTEGER) AS level, {path}, {columns} FROM {relation}{k}"

    return " UNION ALL ".join(one(k) for k in range(len(f.hierarchy), -1, -1))


def _uniform_sql(level: int, path, tag: str) -> str:
    key = ", ".join([f"'{SEED}'", f"'{level}'", *path, "cell_id", f"'{tag}'"])
    return f"((('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)"


def _laplace_sql(level: int, path, epsilon: float) -> str:
    size = lambda tag: f"CAST(floor(-ln({_uniform_sql(level, path, tag)}) / {epsilon!r}::DOUBLE) AS BIGINT)"
    return f"({size('a')} - {size('b')})"


def _noisy_sql(f: Frame, budget: list[float]) -> str:
    out = [_levels_sql(f)]
    for k, b in enumerate(budget):
        out.append(f"noisy{k} AS (SELECT *, n + {_laplace_sql(k, f.hierarchy[:k], b)} AS noisy FROM lev{k})")
    return ", ".join(out)


def _simplex_sql(name: str, rows: str, group: str) -> str:
    """rows: a relation with the group's columns, noisy, p and tb; name: the same with relaxed and x."""
    w = f"PARTITION BY {group}"
    return f"""
{name}_s AS (SELECT *, row_number() OVER ({w} ORDER BY noisy DESC, tb) AS i, CAST(sum(noisy) OVER ({w} ORDER BY noisy DESC, tb ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cs FROM ({rows})),
{name}_a AS (SELECT *, max(CASE WHEN noisy * i > cs - p THEN i END) OVER ({w}) AS k FROM {name}_s),
{name}_b AS (SELECT *, max(CASE WHEN i = k THEN cs - p END) OVER ({w}) AS e FROM {name}_a),
{name}_f AS (SELECT *, coalesce(noisy * k - e > 0, false) AS up FROM {name}_b),
{name}_g AS (SELECT *, CASE WHEN up THEN (noisy * k - e) // k ELSE 0 END AS fl, CASE WHEN up THEN (noisy * k - e) % k ELSE 0 END AS rem,
  CASE WHEN up THEN (noisy * k - e)::DOUBLE / k ELSE 0 END AS relaxed FROM {name}_f),
{name}_r AS (SELECT *, p - CAST(sum(fl) OVER ({w}) AS BIGINT) AS m, row_number() OVER ({w} ORDER BY rem DESC, tb) AS rk FROM {name}_g),
{name} AS (SELECT *, CAST(fl + CASE WHEN rk <= m THEN 1 ELSE 0 END AS BIGINT) AS x FROM {name}_r)"""


def _tie_sql(path) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{SEED}'", *path, "cell_id", "'t'"]) + "))"


def _estimates_sql(f: Frame, budget: list[float]) -> str:
    out = [_noisy_sql(f, budget), "est0 AS (SELECT cell_id, n, noisy, greatest(noisy, 0)::DOUBLE AS relaxed, greatest(noisy, 0) AS x FROM noisy0)"]
    for k in range(1, len(f.hierarchy) + 1):
        path, up = f.hierarchy[:k], f.hierarchy[: k - 1]
        rows = f"SELECT c.*, q.x AS p, {_tie_sql(path).replace('cell_id', 'c.cell_id') if not up else _tie_sql(path)} AS tb FROM noisy{k} c JOIN (SELECT {_list([*up, 'cell_id'])}, x FROM est{k - 1}) q USING ({_list([*up, 'cell_id'])})"
        out.append(_simplex_sql(f"est{k}", rows.replace("c.cell_id", "cell_id"), _list([*up, "cell_id"])))
    return ", ".join(out)


# --- scans, domain, counts -------------------------------------------------------------------------------


@query("SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def scan_project(spark, sf_dir):
    return read_records(spark, CUSTOMERS.records(spark, sf_dir), [*CUSTOMERS.hierarchy, *CUSTOMERS.queries])


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_limit_ordered(spark, sf_dir):
    return read_records(spark, frames.table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"], nrows=100, order_by=["o_orderkey"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def child_filter(spark, sf_dir):
    return frames.table(spark, sf_dir, "nation").where(X.Equal("n_regionkey", 2).to_column()).select("n_nationkey", "n_name")


@query(f"WITH {_domain_sql(LINEITEMS)} SELECT * FROM dom")
def domain(spark, sf_dir):
    return histogram.domain(LINEITEMS.records(spark, sf_dir), list(LINEITEMS.queries))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark, sf_dir):
    return frames.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()


def _tree(spark, sf_dir, f: Frame):
    records = noise.once(histogram.compact(f.records(spark, sf_dir), list(f.hierarchy), list(f.queries)))
    cells = noise.once(histogram.domain(records, list(f.queries)))
    return records, cells, histogram.tree(records, list(f.hierarchy), list(f.queries), cells, cells.count())


@query(f"WITH {_levels_sql(LINEITEMS)} SELECT cell_id, n, {_list(LINEITEMS.queries)} FROM lev0 JOIN dom USING (cell_id)")
def contingency_root(spark, sf_dir):
    _, cells, levels = _tree(spark, sf_dir, LINEITEMS)
    return levels[0].join(F.broadcast(cells), "cell_id")


def _counts(f: Frame):
    return lambda spark, sf_dir: histogram.stacked(_tree(spark, sf_dir, f)[2], list(f.hierarchy), ["cell_id", "n"])


for _name, _f in {"tree_counts": LINEITEMS, "tree_counts_orders": ORDERS, "tree_counts_sparse": SPARSE, "tree_counts_users": USERS, "tree_counts_labelled": LABELLED}.items():
    query(f"WITH {_levels_sql(_f)} {_stack_sql(_f, 'lev', 'cell_id, n')}", _name)(_counts(_f))


def _nodes_sql(f: Frame) -> str:
    levels = []
    for k in range(len(f.hierarchy) + 1):
        path = f.hierarchy[:k]
        levels.append(f"nod{k} AS (SELECT {_list(path)}{', ' if path else ''}count(*) AS real_total FROM rec{' GROUP BY ALL' if path else ''})")
    return f"rec AS ({f.oracle}), " + ", ".join(levels)


@query(f"WITH {_nodes_sql(LINEITEMS)} SELECT *, level = 0 AS is_root, level = {len(LINEITEMS.hierarchy)} AS is_leaf FROM ({_stack_sql(LINEITEMS, 'nod', 'real_total')})")
def tree_nodes(spark, sf_dir):
    h = list(LINEITEMS.hierarchy)
    return histogram.node_flags(histogram.nodes(LINEITEMS.records(spark, sf_dir), h), h)


@query(f"WITH {_nodes_sql(LINEITEMS)} SELECT count(*) AS n_nodes, count(CASE WHEN level < {len(LINEITEMS.hierarchy)} THEN 1 END) AS n_internal_nodes, max(level) AS depth FROM ({_stack_sql(LINEITEMS, 'nod', 'real_total')})")
def node_counts(spark, sf_dir):
    flags = tree_nodes(spark, sf_dir)
    return flags.agg(F.count("*").alias("n_nodes"), F.count(F.when(~F.col("is_leaf"), 1)).alias("n_internal_nodes"), F.max("level").alias("depth"))


@query(f"WITH {_levels_sql(CUSTOMERS)} {_stack_sql(CUSTOMERS, '(SELECT * FROM lev', 'n_total').replace(' FROM (SELECT * FROM lev', ' FROM tot')}".replace("WITH ", "WITH ", 1).replace(" SELECT CAST(2 ", ", " + ", ".join(f"tot{k} AS (SELECT {_list(CUSTOMERS.hierarchy[:k])}{', ' if k else ''}CAST(sum(n) AS BIGINT) AS n_total FROM lev{k}{' GROUP BY ALL' if k else ''})" for k in range(3)) + " SELECT CAST(2 ", 1))
def node_totals(spark, sf_dir):
    _, _, levels = _tree(spark, sf_dir, CUSTOMERS)
    h = list(CUSTOMERS.hierarchy)
    return histogram.stacked([df.groupBy(*h[:k]).agg(F.sum("n").alias("n_total")) for k, df in enumerate(levels)], h, ["n_total"])


@query("SELECT lang, source, count(*) AS real_total, count(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 1 END) AS n_counted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def null_policy(spark, sf_dir):
    """Rows with a null query value are in the real total and in no cell."""
    h = list(LABELLED.hierarchy)
    records, _, levels = _tree(spark, sf_dir, LABELLED)
    counted = levels[-1].groupBy(*h).agg(F.sum("n").alias("n_counted"))
    return histogram.nodes(records, h)[-1].join(counted, h)


# --- predicates and constraints --------------------------------------------------------------------------

MASKS: dict[str, tuple[X.LogicalExpression, str]] = {
    "true": (X.TrueExpression(), "true"),
    "false": (X.FalseExpression(), "false"),
    "eq": (X.Equal("l_linenumber", 3), "l_linenumber = 3"),
    "ne": (X.NotEqual("l_returnflag", "A"), "l_returnflag <> 'A'"),
    "gt": (X.GreaterThan("l_linenumber", 3), "l_linenumber > 3"),
    "ge": (X.GreaterThanOrEqual("l_linenumber", 3), "l_linenumber >= 3"),
    "lt": (X.LessThan("l_returnflag", "N"), "l_returnflag < 'N'"),
    "le": (X.LessThanOrEqual("l_returnflag", "N"), "l_returnflag <= 'N'"),
    "and": (X.And(X.Equal("l_returnflag", "A"), X.LessThan("l_linenumber", 5)), "l_returnflag = 'A' AND l_linenumber < 5"),
    "or": (X.Or(X.Equal("l_returnflag", "A"), X.GreaterThan("l_linenumber", 5)), "l_returnflag = 'A' OR l_linenumber > 5"),
    "not": (X.Not(X.Equal("l_returnflag", "R")), "NOT l_returnflag = 'R'"),
    "implies": (X.Implies(X.Equal("l_returnflag", "N"), X.LessThanOrEqual("l_linenumber", 2)), "NOT l_returnflag = 'N' OR l_linenumber <= 2"),
    "other_kind": (X.Or(X.Equal("l_linenumber", "x"), X.NotEqual("l_returnflag", 1)), "true"),
    "null_literal": (X.Or(X.Equal("l_linenumber", None), X.Not(X.NotEqual("l_returnflag", None))), "false"),
}


def _mask(expression):
    return lambda spark, sf_dir: expression.mask(histogram.domain(LINES.records(spark, sf_dir), list(LINES.queries)))


for _name, (_expression, _sql) in MASKS.items():
    query(f"WITH {_domain_sql(LINES)} SELECT *, ({_sql}) AS mask FROM dom", f"mask_{_name}")(_mask(_expression))

_RULE = X.Implies(X.Equal("l_returnflag", "N"), X.Equal("l_linestatus", "O"))
_RULE_SQL = "(l_returnflag <> 'N' OR l_linestatus = 'O')"


@query(f"WITH {_domain_sql(LINEITEMS)} SELECT cell_id FROM dom WHERE NOT {_RULE_SQL}")
def structural_zero_cells(spark, sf_dir):
    cells = histogram.domain(LINEITEMS.records(spark, sf_dir), list(LINEITEMS.queries))
    return constraints.as_constraint(_RULE).cells(cells)


def _sums() -> dict[str, constraints.Constraint]:
    return {
        "c_sum": constraints.SumEqual(X.Equal("l_returnflag", "A"), 500),
        "c_total": constraints.SumEqualRealTotal(X.NotEqual("l_returnflag", "R")),
        "c_never": constraints.SumEqual(X.Equal("l_returnflag", "Z"), 0),
        "c_max": constraints.ContextualAggregateConstraint(X.TrueExpression(), F.count_distinct("c_mktsegment")),
    }


def _rows(spark, sf_dir):
    records = LINEITEMS.records(spark, sf_dir)
    cells = noise.once(histogram.domain(records, list(LINEITEMS.queries)))
    path = list(LINEITEMS.hierarchy[:1])
    nodes = histogram.nodes(records, list(LINEITEMS.hierarchy))[1]
    return synthesis.all_levels([constraints.constraint_rows(c, cells, records, nodes, path, name) for name, c in _sums().items()]), path


_ROWS_SQL = f"""{_domain_sql(LINEITEMS)}, nod AS (SELECT r_name, count(*) AS t, count(DISTINCT c_mktsegment) AS s FROM rec GROUP BY r_name),
con AS (SELECT r_name, 'c_sum' AS constraint_id, cell_id, CAST(500 AS BIGINT) AS rhs FROM nod LEFT JOIN dom ON l_returnflag = 'A'
 UNION ALL SELECT r_name, 'c_total', cell_id, t FROM nod LEFT JOIN dom ON l_returnflag <> 'R'
 UNION ALL SELECT r_name, 'c_never', cell_id, CAST(0 AS BIGINT) FROM nod LEFT JOIN dom ON l_returnflag = 'Z'
 UNION ALL SELECT r_name, 'c_max', cell_id, s FROM nod LEFT JOIN dom ON true)"""


@query(f"WITH {_ROWS_SQL} SELECT r_name, constraint_id, coalesce(cell_id, -1) AS cell_id, rhs FROM con")
def sum_constraint_rows(spark, sf_dir):
    return _rows(spark, sf_dir)[0].withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))


@query(f"WITH {_ROWS_SQL} SELECT r_name, constraint_id, rhs, count(cell_id) AS n_cells, CASE WHEN count(cell_id) > 0 THEN 'active' WHEN rhs = 0 THEN 'trivial' ELSE 'infeasible' END AS status FROM con GROUP BY r_name, constraint_id, rhs")
def trivial_constraints(spark, sf_dir):
    return constraints.folded(*_rows(spark, sf_dir))


@query(f"WITH {_nodes_sql(ORDERS)} {_stack_sql(ORDERS, 'nod', 'real_total')}")
def real_totals_by_level(spark, sf_dir):
    h = list(ORDERS.hierarchy)
    return histogram.stacked(histogram.nodes(ORDERS.records(spark, sf_dir), h), h, ["real_total"])


@query(f"WITH rec AS ({LINEITEMS.oracle}) SELECT r_name, n_name, count(CASE WHEN l_returnflag = 'A' OR o_orderpriority < '2' THEN 1 END) AS masked_sum FROM rec GROUP BY r_name, n_name")
def masked_sum_by_node(spark, sf_dir):
    _, cells, levels = _tree(spark, sf_dir, LINEITEMS)
    return synthesis.masked_sums(levels[2], cells, X.Or(X.Equal("l_returnflag", "A"), X.LessThan("o_orderpriority", "2")), ["r_name", "n_name"])


# --- budgets, noise, statistics --------------------------------------------------------------------------


def _budget_rows(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "level int, epsilon double")


@query("SELECT CAST(i AS INTEGER) AS level, 10.0::DOUBLE / 63 * pow(2, i) AS epsilon FROM range(6) t(i)")
def budget_geometric(spark, sf_dir):
    return _budget_rows(spark, noise.geometric_budget(10.0, 6)).withColumn("epsilon", F.round("epsilon", 9))


ORACLES["budget_geometric"] = "SELECT CAST(i AS INTEGER) AS level, round(10.0::DOUBLE / 63 * pow(2, i), 9) AS epsilon FROM range(6) t(i)"


@query("SELECT CAST(i AS INTEGER) AS level, 2.5::DOUBLE AS epsilon FROM range(4) t(i)")
def budget_uniform(spark, sf_dir):
    return _budget_rows(spark, noise.uniform_budget(10.0, 4))


BUDGET = [0.25, 0.5, 1.0]


def _measured(spark, sf_dir, f: Frame = CUSTOMERS, budget=None, name: str = "seeded_laplace"):
    _, cells, levels = _tree(spark, sf_dir, f)
    return cells, noise.measure(levels, list(f.hierarchy), name, budget or BUDGET, SEED)


@query(f"WITH {_noisy_sql(CUSTOMERS, BUDGET)} {_stack_sql(CUSTOMERS, 'noisy', 'cell_id, n, noisy')}")
def noise_seeded_laplace(spark, sf_dir):
    return histogram.stacked(_measured(spark, sf_dir)[1], list(CUSTOMERS.hierarchy), ["cell_id", "n", "noisy"])


_SIGMA2 = 6.25
_REACH = math.ceil(9 * math.sqrt(_SIGMA2))


@query(
    f"""WITH {_levels_sql(CUSTOMERS)}, pmf AS (SELECT CAST(x AS BIGINT) AS x, exp(-x * x / (2 * {_SIGMA2}::DOUBLE)) AS w FROM range(-{_REACH}, {_REACH} + 1) t(x)),
cdf AS (SELECT x, sum(w) OVER (ORDER BY x) / sum(w) OVER () AS c FROM pmf), u AS (SELECT *, {_uniform_sql(2, CUSTOMERS.hierarchy, "g")} AS u FROM lev2)
SELECT r_name, n_name, cell_id, n, n + (SELECT count(*) FROM cdf WHERE c < u AND x < {_REACH}) - {_REACH} AS noisy FROM u"""
)
def noise_seeded_gaussian(spark, sf_dir):
    return _measured(spark, sf_dir, budget=[_SIGMA2] * 3, name="seeded_gaussian")[1][2]


@query("SELECT round(sum(exp(-x * x / 12.5::DOUBLE)), 9) AS norm_const FROM range(-60, 61) t(x)")
def norm_const(spark, sf_dir):
    return statistics.normalizing_constant(spark, 6.25).select(F.round("norm_const", 9).alias("norm_const"))


@query("SELECT round(sum(exp(-x * x / 0.5::DOUBLE)), 9) AS norm_const FROM range(-60, 61) t(x)")
def norm_const_small(spark, sf_dir):
    return statistics.normalizing_constant(spark, 0.25).select(F.round("norm_const", 9).alias("norm_const"))


@query("SELECT round(sum(x * x * exp(-x * x / 12.5::DOUBLE)) / sum(exp(-x * x / 12.5::DOUBLE)), 9) AS variance FROM range(-60, 61) t(x)")
def dgauss_variance(spark, sf_dir):
    return statistics.variance(spark, 6.25).select(F.round("variance", 9).alias("variance"))


def _noise_sample(spark, sf_dir):
    return _measured(spark, sf_dir, budget=[_SIGMA2] * 3, name="seeded_gaussian")[1][2].withColumn("noise", F.col("noisy") - F.col("n"))


_SAMPLE_SQL = ORACLES["noise_seeded_gaussian"]


@query(f"SELECT noisy - n AS value, count(*) AS n FROM ({_SAMPLE_SQL}) GROUP BY 1")
def noise_histogram(spark, sf_dir):
    return statistics.value_counts(_noise_sample(spark, sf_dir))


@query(
    f"""WITH h AS (SELECT noisy - n AS value, count(*) AS n FROM ({_SAMPLE_SQL}) GROUP BY 1), t AS (SELECT sum(n) AS t FROM h), z AS (SELECT sum(exp(-x * x / 12.5::DOUBLE)) AS z FROM range(-60, 61) t(x))
SELECT CAST(sum(n) AS BIGINT) AS n_samples, round(sum(value * n / t), 9) AS mean, round(sum(value * value * n / t), 9) AS second_moment, round(sum(n / t * (ln(n / t * z) + value * value / 12.5::DOUBLE)), 9) AS kl FROM h, t, z"""
)
def noise_stats(spark, sf_dir):
    z = statistics.normalizing_constant(spark, _SIGMA2).first().norm_const
    stats = statistics.sample_statistics(statistics.value_counts(_noise_sample(spark, sf_dir)), _SIGMA2, z)
    return stats.select("n_samples", *(F.round(c, 9).alias(c) for c in ("mean", "second_moment", "kl")))


@query()
def noise_exact(spark, sf_dir):
    """All three exact mechanisms over the leaves; drawn anew each time, so there is nothing to compare but the shape."""
    _, _, levels = _tree(spark, sf_dir, CUSTOMERS)
    parts = [noise.once(noise.add_noise(levels[2], name, p, list(CUSTOMERS.hierarchy), 2)).withColumn("mechanism", F.lit(name)) for name, p in (("discrete_laplace", 1.0), ("discrete_gaussian", 4.0), ("discrete_gaussian_zcdp", 0.5))]
    return synthesis.all_levels(parts)


@query(
    """WITH t AS (SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer))
SELECT mechanism, 400 * n AS n_draws, true AS mean_ok, true AS variance_ok FROM t, (VALUES ('discrete_laplace'), ('discrete_gaussian'), ('discrete_gaussian_zcdp')) m(mechanism)"""
)
def noise_exact_moments(spark, sf_dir):
    """A check of properties: 400 draws for each leaf cell; mean and variance within eight standard errors of what the
    distributions have (a row of false is expected once in 10^14 runs)."""
    _, _, levels = _tree(spark, sf_dir, CUSTOMERS)
    many = levels[2].select("cell_id", F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(400))))
    out = []
    for name, p in (("discrete_laplace", 1.0), ("discrete_gaussian", 4.0), ("discrete_gaussian_zcdp", 0.5)):
        pmf = _pmf(name, p)
        second, fourth = (sum(x**k * w for x, w in pmf) for k in (2, 4))
        drawn = noise.once(noise.add_noise(many, name, p, [], 2)).agg(F.count("*").alias("n_draws"), F.avg("noisy").alias("m"), F.avg(F.col("noisy") * F.col("noisy")).alias("v"))
        error = lambda spread: F.sqrt(F.lit(spread) / F.col("n_draws")) * 8
        out.append(drawn.select(F.lit(name).alias("mechanism"), "n_draws", (F.abs("m") < error(second)).alias("mean_ok"), (F.abs(F.col("v") - second) < error(fourth - second**2)).alias("variance_ok")))
    return synthesis.all_levels(out)


def _pmf(name: str, p: float) -> list[tuple[int, float]]:
    sigma2 = {"discrete_gaussian": p, "discrete_gaussian_zcdp": 1 / (2 * p)}.get(name)
    weights = [(x, math.exp(-p * abs(x) if sigma2 is None else -x * x / (2 * sigma2))) for x in range(-80, 81)]
    total = sum(w for _, w in weights)
    return [(x, w / total) for x, w in weights]


# --- estimates -------------------------------------------------------------------------------------------


def _estimates(spark, sf_dir, f: Frame = CUSTOMERS, budget=None):
    cells, measured = _measured(spark, sf_dir, f, budget)
    free = [constraints.Compiled(set(), [])] * len(measured)
    return cells, estimate.estimate(measured, list(f.hierarchy), free, SEED)


_EST = _estimates_sql(CUSTOMERS, BUDGET)


@query(f"WITH {_noisy_sql(CUSTOMERS, BUDGET)} SELECT cell_id, n, noisy, greatest(noisy, 0)::DOUBLE AS relaxed, greatest(noisy, 0) AS x FROM noisy0")
def estimate_root_nonneg(spark, sf_dir):
    return estimate.estimate_root(_measured(spark, sf_dir)[1][0], constraints.Compiled(set(), []), SEED)


_ROOT_TOTAL = f"{_noisy_sql(CUSTOMERS, BUDGET)}, " + _simplex_sql("e", f"SELECT *, 0 AS g, (SELECT count(*) FROM rec) AS p, {_tie_sql(())} AS tb FROM noisy0", "g")


@query(f"WITH {_ROOT_TOTAL} SELECT cell_id, n, noisy, round(relaxed, 9) AS relaxed, x FROM e")
def estimate_root_total(spark, sf_dir):
    records = CUSTOMERS.records(spark, sf_dir)
    cells, measured = _measured(spark, sf_dir)
    nodes = histogram.nodes(records, list(CUSTOMERS.hierarchy))[0]
    held = constraints.compile_level([constraints.SumEqualRealTotal(X.TrueExpression())], cells, records, nodes, [])
    return estimate.estimate_root(measured[0], held, SEED).withColumn("relaxed", F.round("relaxed", 9))


@query(f"WITH {_EST} {_stack_sql(CUSTOMERS, 'est', 'cell_id, round(relaxed, 9) AS relaxed')}")
def estimate_children_relaxed(spark, sf_dir):
    out = histogram.stacked(_estimates(spark, sf_dir)[1], list(CUSTOMERS.hierarchy), ["cell_id", "relaxed"])
    return out.withColumn("relaxed", F.round("relaxed", 9))


@query(f"WITH {_EST} {_stack_sql(CUSTOMERS, 'est', 'cell_id, x')}")
def estimate_children_rounded(spark, sf_dir):
    return histogram.stacked(_estimates(spark, sf_dir)[1], list(CUSTOMERS.hierarchy), ["cell_id", "x"])


_DEEP = [0.25, 0.5, 1.0, 2.0]


@query(f"WITH {_estimates_sql(LINEITEMS, _DEEP)} {_stack_sql(LINEITEMS, 'est', 'cell_id, x')}")
def estimate_deep_tree(spark, sf_dir):
    return histogram.stacked(_estimates(spark, sf_dir, LINEITEMS, _DEEP)[1], list(LINEITEMS.hierarchy), ["cell_id", "x"])


def _engine(spark, sf_dir, f: Frame, budget, mechanism: str = "seeded_laplace") -> TopDown:
    engine = TopDown(spark, f.records(spark, sf_dir), list(f.hierarchy), list(f.queries), seed=SEED)
    engine.set_mechanism(mechanism)
    return engine.set_privacy_parameters(budget)


def _margins(engine: TopDown, rule: X.LogicalExpression | None) -> DataFrame:
    """Errors that an estimate may not have, in one row."""
    h, parts = engine.hierarchy, []
    for k in range(len(h)):
        parts.append(synthesis.cell_violations(engine.estimates[k], engine.estimates[k + 1], h[:k]).agg(F.count("*").alias("n")).withColumn("what", F.lit("consistency_errors")))
    rows = engine.tree()
    totals = histogram.stacked(engine.nodes, h, ["real_total"])
    sums = rows.groupBy("level", *h).agg(F.sum("x").alias("x"))
    same = sums.level == totals.level
    for c in h:
        same = same & sums[c].eqNullSafe(totals[c])
    parts.append(sums.join(totals, same).agg(F.count(F.when(F.col("x") != F.col("real_total"), 1)).alias("n")).withColumn("what", F.lit("total_errors")))
    parts.append(rows.agg(F.count(F.when(F.col("x") < 0, 1)).alias("n")).withColumn("what", F.lit("negatives")))
    if rule is not None:
        cells = constraints.as_constraint(rule).cells(engine.domain)
        parts.append(rows.join(F.broadcast(cells), "cell_id").agg(F.count(F.when(F.col("x") != 0, 1)).alias("n")).withColumn("what", F.lit("rule_errors")))
    return synthesis.all_levels(parts).groupBy("what").agg(F.sum("n").alias("n_errors"))


@query("SELECT * FROM (VALUES ('consistency_errors', 0::BIGINT), ('total_errors', 0::BIGINT), ('negatives', 0::BIGINT), ('rule_errors', 0::BIGINT)) t(what, n_errors)")
def estimate_children_with_totals(spark, sf_dir):
    """A check of properties: real totals and a rule on all levels, with noise; no margin may be off."""
    engine = _engine(spark, sf_dir, LINEITEMS, _DEEP)
    engine.set_constraint_to_tree(constraints.SumEqualRealTotal(X.TrueExpression()))
    engine.set_constraint_to_tree(_RULE)
    engine.initialize().measurement_phase().estimation_phase()
    return _margins(engine, _RULE)


@query("SELECT * FROM (VALUES ('consistency_errors', 0::BIGINT), ('negatives', 0::BIGINT), ('sum_errors', 0::BIGINT)) t(what, n_errors)")
def estimate_overlapping(spark, sf_dir):
    """A check of properties: two sums at the root that share cells, equal to what the records say, with noise."""
    engine = _engine(spark, sf_dir, LINEITEMS, _DEEP)
    sums = [X.LessThan("l_returnflag", "R"), X.GreaterThan("l_returnflag", "A")]
    for e in sums:
        counted = F.count(F.when(e.to_column(LINEITEMS.records(spark, sf_dir).schema), 1))
        engine.set_constraint_to_level(0, constraints.ContextualAggregateConstraint(e, counted))
    engine.initialize().measurement_phase().estimation_phase()
    out = _margins(engine, None).where("what <> 'total_errors'")
    root = engine.estimates[0].join(F.broadcast(engine.domain), "cell_id")
    held = [F.sum(F.when(e.to_column(engine.domain.schema), F.col("x") - F.col("n"))) != 0 for e in sums]
    errors = root.agg(sum((h.cast("long") for h in held[1:]), held[0].cast("long")).alias("n_errors"))
    return out.unionByName(errors.select(F.lit("sum_errors").alias("what"), "n_errors"))


class _WeightedTotal(constraints.ContextualAggregateConstraint):
    """The root's cells, records with 'R' counting threefold and those with 'A' twofold, add up to what the records say."""

    def weights(self):
        return _flag_weight()


def _flag_weight():
    return F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)


@query(f"WITH rec AS ({LINEITEMS.oracle}) SELECT k::INT AS level, sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)::BIGINT AS weighted_sum FROM rec, range(4) t(k) GROUP BY k")
def estimate_weighted(spark, sf_dir):
    """With noise; all levels add up to the weighted sum that the root was given."""
    engine = _engine(spark, sf_dir, LINEITEMS, _DEEP)
    engine.set_constraint_to_level(0, _WeightedTotal(X.TrueExpression(), F.sum(_flag_weight())))
    engine.initialize().measurement_phase().estimation_phase()
    return engine.tree().join(F.broadcast(engine.domain), "cell_id").groupBy(F.col("level").cast("int").alias("level")).agg(F.sum(F.col("x") * _flag_weight()).cast("long").alias("weighted_sum"))


@query(f"WITH rec AS ({LINEITEMS.oracle}) SELECT 'ASIA' AS r_name, 'A' AS l_returnflag, count(*) AS n FROM rec WHERE r_name = 'ASIA' AND l_returnflag = 'A' UNION ALL SELECT 'EUROPE', 'R', 0::BIGINT")
def estimate_of_one_node(spark, sf_dir):
    """With noise; one node has a real sum and another a rule, the others neither."""
    engine = _engine(spark, sf_dir, LINEITEMS, _DEEP)
    engine.set_constraint_to_node(["ASIA"], constraints.ContextualAggregateConstraint(X.Equal("l_returnflag", "A"), F.count(F.when(F.col("l_returnflag") == "A", 1))))
    engine.set_constraint_to_node(["EUROPE"], X.NotEqual("l_returnflag", "R"))
    engine.initialize().measurement_phase().estimation_phase()
    cells = engine.estimates[1].join(F.broadcast(engine.domain), "cell_id")
    return cells.where("(r_name, l_returnflag) IN (('ASIA', 'A'), ('EUROPE', 'R'))").groupBy("r_name", "l_returnflag").agg(F.sum("x").alias("n"))


# --- reconstruction and audit ----------------------------------------------------------------------------


@query(CUSTOMERS.oracle)
def synth_noise_free(spark, sf_dir):
    return _engine(spark, sf_dir, CUSTOMERS, [1.0] * 3, "none").run()


@query(f"WITH {_EST} SELECT r_name, n_name, c_mktsegment FROM (SELECT r_name, n_name, cell_id, unnest(range(x)) AS k FROM est2 WHERE x > 0) JOIN dom USING (cell_id)")
def synth_seeded(spark, sf_dir):
    return _engine(spark, sf_dir, CUSTOMERS, BUDGET).run()


@query(f"WITH {_estimates_sql(LINEITEMS, _DEEP)} SELECT {_list([*LINEITEMS.hierarchy, *LINEITEMS.queries])}, x AS n FROM est3 JOIN dom USING (cell_id) WHERE x > 0")
def synth_seeded_counts(spark, sf_dir):
    out = _engine(spark, sf_dir, LINEITEMS, _DEEP).run()
    return out.groupBy(*LINEITEMS.hierarchy, *LINEITEMS.queries).agg(F.count("*").alias("n"))


@query(f"WITH {_EST}, b AS (SELECT (SELECT sum(x) FROM est0) AS p, (SELECT sum(x) FROM est1) AS c), d AS (SELECT r_name, sum(x) AS p FROM est1 GROUP BY 1), e AS (SELECT r_name, sum(x) AS c FROM est2 GROUP BY 1) SELECT 0 AS level, (SELECT count(*) FROM b WHERE p <> c) AS n_violations UNION ALL SELECT 1, (SELECT count(*) FROM d JOIN e USING (r_name) WHERE p <> c)")
def check_totals(spark, sf_dir):
    levels, h = _estimates(spark, sf_dir)[1], list(CUSTOMERS.hierarchy)
    return synthesis.all_levels([synthesis.total_violations(levels[k], levels[k + 1], h[:k]).agg(F.count("*").alias("n_violations")).select(F.lit(k).alias("level"), "n_violations") for k in (0, 1)])


@query(f"WITH {_noisy_sql(CUSTOMERS, BUDGET)}, d AS (SELECT r_name, cell_id, sum(noisy) AS c FROM noisy2 GROUP BY ALL) SELECT r_name, cell_id, noisy AS total, CAST(c AS BIGINT) AS children_total FROM noisy1 JOIN d USING (r_name, cell_id) WHERE noisy <> c")
def check_cells(spark, sf_dir):
    """Measured counts aren't consistent; these are the cells where they aren't."""
    measured = _measured(spark, sf_dir)[1]
    return synthesis.cell_violations(measured[1], measured[2], ["r_name"], "noisy")


@query(f"WITH {_EST} SELECT r_name, n_name, sum(abs(n - x))::DOUBLE AS manhattan, round(sqrt(sum((n - x) * (n - x))), 9) AS euclidean, round(1 - sum(n * x) / (sqrt(sum(n * n)) * sqrt(sum(x * x))), 9) AS cosine FROM est2 GROUP BY ALL")
def distances(spark, sf_dir):
    out = synthesis.distances(_estimates(spark, sf_dir)[1][2], list(CUSTOMERS.hierarchy))
    return out.select(*CUSTOMERS.hierarchy, "manhattan", F.round("euclidean", 9).alias("euclidean"), F.round("cosine", 9).alias("cosine"))

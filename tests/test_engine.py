import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallytree.functions.expressions import Equal, FalseExpression, Implies, NotEqual, TrueExpression
from tallytree.operators import constraints as C
from tallytree.operators import histogram, noise, synthesis
from tallytree.plans.engine import TopDown
from tallytree.sources import read_records, write_records

ROWS = [("a", "x", 1, "p"), ("a", "x", 1, "p"), ("a", "y", 2, "q"), ("b", "x", 1, "q"), ("b", "z", 2, "q"), ("b", "z", 1, None)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "g string, h string, i int, s string")


def engine(spark, records, mechanism="seeded_laplace", budget=(0.5, 0.5, 0.5), **more):
    e = TopDown(spark, records, ["g", "h"], ["i", "s"], seed=11, **more).set_mechanism(mechanism)
    return e.set_privacy_parameters(list(budget))


def test_noise_free_gives_back_what_was_counted(spark, records):
    out = engine(spark, records, "none").run()
    assert out.dtypes == [("g", "string"), ("h", "string"), ("i", "int"), ("s", "string")]
    assert Counter(map(tuple, out.collect())) == Counter(r for r in ROWS if r[3] is not None)


def test_null_as_a_value(spark, records):
    out = engine(spark, records, "none", null_policy="value").run()
    assert Counter(map(tuple, out.collect())) == Counter(ROWS)


@pytest.mark.parametrize("mechanism", ["seeded_laplace", "discrete_laplace", "discrete_gaussian_zcdp"])
def test_totals_rules_and_consistency(spark, records, mechanism):
    e = engine(spark, records, mechanism)
    rule = Implies(Equal("i", 1), NotEqual("s", "q"))
    e.set_constraint_to_tree(C.SumEqualRealTotal(TrueExpression())).set_constraint_to_tree(rule)
    e.run()
    e.check_correctness()
    rows = e.tree().join(e.domain, "cell_id").collect()
    assert min(r.x for r in rows) >= 0
    assert not [r for r in rows if r.i == 1 and r.s == "q" and r.x]
    totals = Counter()
    for r in rows:
        totals[(r.g, r.h)] += r.x
    real = Counter()
    for g, h, *_ in ROWS:
        for path in ((None, None), (g, None), (g, h)):
            real[path] += 1
    assert totals == real


def test_records_are_read_once(spark, records, tmp_path):
    """Everything after the first aggregation comes from its counts, and from no table."""
    records.write.parquet(str(tmp_path / "r.parquet"))
    e = engine(spark, str(tmp_path / "r.parquet"), "none").initialize()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan(e.records)
    for df in (e.counted, e.domain, *e.nodes, *e.levels):
        assert "parquet" not in plan(df)
    assert {(r.g, r.h): r.real_total for r in e.nodes[2].collect()} == Counter((g, h) for g, h, *_ in ROWS)


def test_every_cell_of_every_node(spark):
    counts = spark.createDataFrame([("a", 0, 2), ("a", 3, 1), ("c", 4, 7)], "h string, cell_id int, n long")
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "h string")
    got = {(r.h, r.cell_id): r.n for r in histogram.dense(counts, paths, ["h"], 5).collect()}
    assert got == {(h, c): {("a", 0): 2, ("a", 3): 1, ("c", 4): 7}.get((h, c), 0) for h in "abc" for c in range(5)}
    assert histogram.dense(counts.limit(0), paths, ["h"], 0).count() == 0
    assert [r.n for r in histogram.dense(counts.limit(0).drop("h"), paths.limit(1).drop("h"), [], 3).collect()] == [0, 0, 0]


def test_level_order_nodes_and_distances(spark, records):
    e = engine(spark, records, "none")
    e.run()
    assert [k for k, _ in e.iterate_by_levels()] == [0, 1, 2] and e.n_nodes() == (7, 3)
    assert [tuple(r) for r in e.distances(0).collect()] == [(0.0, 0.0, 0.0)] and e.distances(1).columns == ["g", "manhattan", "euclidean", "cosine"]
    total = lambda frame: frame[["g"]].head(1).assign(cells=len(frame), total=frame.n.sum())
    assert {tuple(r) for r in histogram.apply_to_nodes(e.levels[1], ["g"], total, "g string, cells long, total long").collect()} == {("a", 4, 3), ("b", 4, 2)}


def test_one_import_for_all():
    import tallytree

    assert tallytree.TopDown is TopDown and tallytree.Equal is Equal and tallytree.SumEqual is C.SumEqual
    assert all(getattr(tallytree, name) for name in tallytree.__all__)
    with pytest.raises(AttributeError):
        tallytree.nothing  # noqa: B018


def test_user_expression(spark, records):
    from tallytree import LogicalExpression

    class Even(LogicalExpression):
        def to_column(self, schema=None):
            return F.col("i") % 2 == 0

    e = engine(spark, records, "none")
    e.set_constraint_to_tree(C.SumEqual(Even(), 0))
    e.run()
    rows = e.estimates[2].join(e.domain, "cell_id").collect()
    assert sum(r.x for r in rows if r.i == 2) == 0 and sum(r.x for r in rows) > 0


def test_measured_once(spark, records):
    e = engine(spark, records, "discrete_laplace").initialize().measurement_phase()
    assert e.measured[2].collect() == e.measured[2].collect()


def test_zero_sum_and_contextual(spark, records):
    e = engine(spark, records)
    e.set_constraint_to_tree(C.SumEqual(Equal("s", "q"), 0))
    e.set_constraint_to_level(0, C.ContextualAggregateConstraint(Equal("s", "p"), F.count(F.lit(1))))
    e.initialize().measurement_phase().estimation_phase()
    root = e.estimates[0].join(e.domain, "cell_id").collect()
    assert sum(r.x for r in root if r.s == "q") == 0 and sum(r.x for r in root if r.s == "p") == 6
    f = C.ContextualAggregateConstraint(TrueExpression(), lambda frame: len(frame))
    assert {r.g: r.rhs for r in f.right_hand_sides(records, e.nodes[1], ["g"]).collect()} == {"a": 3, "b": 3}


def test_infeasible(spark, records):
    e = engine(spark, records)
    e.set_constraint_to_tree(C.SumEqual(TrueExpression(), 7))
    with pytest.raises(Exception, match="under the root|can't"):
        e.run()
    e = engine(spark, records)
    e.set_constraint_to_tree(C.SumEqual(FalseExpression(), 5))
    with pytest.raises(C.InfeasibleError, match="SumEqual"):
        e.run()
    e = engine(spark, records)
    e.set_constraint_to_tree(C.SumEqual(TrueExpression(), -1))
    with pytest.raises(C.InfeasibleError):
        e.run()


def test_weighted_sum(spark, records):
    """At the root, i counts as its value: 4 records of 1 and 2 of 2, but the one with a null is in no cell."""
    e = engine(spark, records)
    e.set_constraint_to_level(0, C.WeightedSumEqual(TrueExpression(), F.col("i"), 7))
    e.run()
    e.check_correctness()
    for level in e.estimates:
        assert level.join(e.domain, "cell_id").agg(F.sum(F.col("x") * F.col("i"))).first()[0] == 7
    with pytest.raises(ValueError, match="whole numbers"):
        bad = engine(spark, records).set_constraint_to_level(0, C.WeightedSumEqual(TrueExpression(), F.col("i") / 4, 7))
        bad.run()


def test_constraints_of_one_node(spark, records):
    e = engine(spark, records, "seeded_laplace", (9, 9, 9))
    e.set_constraint_to_level(0, C.SumEqualRealTotal(TrueExpression()))
    e.set_constraint_to_node(["b"], C.SumEqual(TrueExpression(), 2))
    e.set_constraint_to_node(["a", "y"], NotEqual("s", "p"))
    e.run()
    e.check_correctness()
    x = {(r.g, r.h, r.s): r.x for r in e.estimates[2].join(e.domain, "cell_id").groupBy("g", "h", "s").agg(F.sum("x").alias("x")).collect()}
    assert sum(v for k, v in x.items() if k[0] == "b") == 2 and sum(x.values()) == 6 and x["a", "y", "p"] == 0
    # the other parents of that level are estimated as without it
    plain = engine(spark, records, "seeded_laplace", (9, 9, 9))
    plain.set_constraint_to_level(0, C.SumEqualRealTotal(TrueExpression()))
    plain.set_constraint_to_node(["b"], C.SumEqual(TrueExpression(), 2))
    plain.run()
    cells = lambda f: {(r.h, r.cell_id): (r.relaxed, r.x) for r in f.estimates[2].where("g = 'b'").collect()}
    assert cells(e) == cells(plain)
    for path in (["c"], ["a", "q"]):
        with pytest.raises(ValueError, match="no such node"):
            engine(spark, records).set_constraint_to_node(path, Equal("i", 1)).run()
    with pytest.raises(ValueError, match="no level"):
        engine(spark, records).set_constraint_to_node(["a", "x", "z"], Equal("i", 1))
    root = engine(spark, records).set_constraint_to_node([], C.SumEqual(Equal("i", 1), 3))
    root.run()
    assert root.estimates[0].join(root.domain, "cell_id").where("i = 1").agg(F.sum("x")).first()[0] == 3


def test_equations_of_what_cannot_hold(spark, records):
    e = engine(spark, records)
    e.set_constraint_to_level(1, C.SumEqual(Equal("i", 1), 7)).set_constraint_to_level(0, NotEqual("s", "q"))
    with pytest.raises(Exception, match="under the root"):
        e.run()
    rows = e.equations().collect()  # the root went well, its children didn't
    assert len(e.estimates) == 1 and {(r.g, r.weight, r.rhs) for r in rows} == {("a", 1, 7), ("b", 1, 7)} and len(rows) == 4
    assert {r.constraint for r in e.equations(0).collect()} == {repr(c) for c in e.constraints.at(0)}
    assert e.equations(2).count() == 0


def test_levels():
    c = C.SumEqual(TrueExpression(), 1)
    documented, offset = C.Registry(3), C.Registry(3, "offset")
    documented.add(c, 1), offset.add(c, 1)
    assert [len(documented.at(k)) for k in range(4)] == [1, 1, 0, 0]
    assert [len(offset.at(k)) for k in range(4)] == [1, 1, 1, 0]
    with pytest.raises(ValueError):
        documented.add(c, 4)
    with pytest.raises(TypeError):
        documented.add("x")


def test_validation(spark, records):
    for h, q in (([], ["i"]), (["g"], []), (["g"], ["g"])):
        with pytest.raises(ValueError):
            TopDown(spark, records, h, q)
    with pytest.raises(ValueError):
        engine(spark, records, budget=[1.0])
    with pytest.raises(ValueError):
        engine(spark, records, budget=[1.0, 0.0, 1.0])
    with pytest.raises(ValueError):
        engine(spark, records, "rumour")
    with pytest.raises(ValueError, match="cells"):
        engine(spark, records, most_cells=3).run()
    with pytest.raises(ValueError, match="cells"):
        engine(spark, records, most_cells=1, public_cells=records.select("i", "s")).initialize()
    with pytest.raises(ValueError, match="null"):
        histogram.check_hierarchy(records.withColumn("g", F.when(F.col("i") == 1, F.col("g"))), ["g"])


def test_files(spark, records, tmp_path):
    path = write_records(records, str(tmp_path / "out.csv"), sep=";")
    again = read_records(spark, path, ["g", "i"], sep=";", format="csv")
    assert sorted(map(tuple, again.collect())) == sorted((r[0], r[2]) for r in ROWS)
    assert read_records(spark, path, ["i"], sep=";", format="csv", nrows=2).count() == 2
    with pytest.raises(ValueError):
        read_records(spark, path, ["nothing"], sep=";", format="csv")
    records.write.parquet(str(tmp_path / "r.parquet"))
    assert read_records(spark, str(tmp_path / "r.parquet"), ["h"], nrows=-1).columns == ["h"]


def test_many_copies(spark):
    cells = spark.createDataFrame([(0, "u"), (1, "v")], "cell_id int, q string")
    leaves = spark.createDataFrame([("a", 0, 250_000), ("a", 1, 0), ("b", 1, 3)], "h string, cell_id int, x long")
    out = synthesis.synthesise(leaves, cells, ["h"], ["q"])
    assert {(r.h, r.q): r["count"] for r in out.groupBy("h", "q").count().collect()} == {("a", "u"): 250_000, ("b", "v"): 3}


def test_user_mechanism_and_budget(spark, records):
    noise.register_mechanism("plus_one", lambda parameter: 1)
    e = engine(spark, records, "plus_one").initialize().measurement_phase()
    assert {r.noisy - r.n for r in e.measured[1].collect()} == {1}
    assert sum(noise.geometric_budget(10, 6)) == pytest.approx(10) and noise.uniform_budget(10, 4) == [2.5] * 4


def test_removal_of_the_llm_folders():
    """The entry module imports and works without them."""
    import subprocess
    import sys
    import tempfile

    from conftest import ROOT

    with tempfile.TemporaryDirectory() as d:
        subprocess.run(f"cp -r {ROOT}/tallytree {ROOT}/__spark_entry__.py {d} && rm -rf {d}/tallytree/llm", shell=True, check=True)
        code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not [n for n in e.queries() if n.startswith('op')] and len(e.oracle_sql()) > 40"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=d, check=True, env={"PATH": "/usr/bin:/bin"})


def test_own_generator_for_noise(spark, records):
    def fixed():
        return random.Random(3)

    one = spark.range(0, 500, 1, 1).select(F.col("id").cast("int").alias("cell_id"), F.lit(0).cast("long").alias("n"))
    for name in ("discrete_laplace", "discrete_gaussian", "discrete_gaussian_zcdp"):
        a, b = ([r.noisy for r in noise.add_noise(one, name, 0.5, [], 0, rng=fixed).orderBy("cell_id").collect()] for _ in range(2))
        c = [r.noisy for r in noise.add_noise(one, name, 0.5, [], 0).orderBy("cell_id").collect()]
        assert a == b != c
    e = engine(spark, records, "discrete_laplace", noise_rng=fixed)
    e.run()
    e.check_correctness()

"""Decision trees of pair classification."""

import math
import random
import statistics

import pytest

from netquant.operators import pairs

INF, NAN = float("inf"), float("nan")

# u1, s, u2, n_sharing, case, side 1, side 2, shared
FOLD = [
    (NAN, 1.0, 1.0, 2, "CASE6", False, False, False),
    (0.0, 0.2, 0.5, 2, "CASE6", False, False, False),
    (0.0, 2.0, 4.0, 2, "CASE4", True, True, False),
    (4.0, 2.0, 0.0, 2, "CASE4", True, True, False),
    (0.0, 0.5, 4.0, 2, "CASE3", False, True, False),
    (0.0, 3.5, 4.0, 2, "CASE3", True, False, False),
    (4.0, 3.5, 0.0, 2, "CASE3", False, True, False),
    (-INF, 0.0, INF, 2, "CASE3", True, True, False),
    (0.0, 3.0, INF, 2, "CASE3", False, True, False),
    (0.0, 5.0, 1.0, 2, "CASE1", False, False, True),
    (0.0, 5.0, 1.0, 3, "CASE2", False, False, True),
    (0.0, -0.5, 3.0, 2, "CASE3", False, True, False),
    (0.0, 3.5, 3.0, 2, "CASE3", True, False, False),
    (3.0, 3.5, 0.0, 2, "CASE3", False, True, False),
    (0.0, 0.9, 0.5, 2, "CASE5", False, False, False),
    (INF, INF, INF, 2, "CASE6", False, False, False),
    (INF, 1.0, INF, 2, "CASE1", False, False, True),
]


def test_fold_change_tree(spark):
    rows = [(i, *case[:4]) for i, case in enumerate(FOLD)]
    df = spark.createDataFrame(rows, "i int, u1 double, s double, u2 double, n_sharing long")
    for row in pairs.classify_fold_change(df).orderBy("i").collect():
        want = FOLD[row.i]
        got = (row.fold_case, row.unique_1_inconsistent, row.unique_2_inconsistent, row.shared_inconsistent)
        assert got == want[4:], (want, got)


def test_statistical_test_replaces_the_middle_rule(spark):
    rows = [(0.0, 2.0, 4.0, 2, "CASE3"), (0.0, 2.0, 4.0, 2, "CASE0"), (0.0, 2.0, 4.0, 2, None), (0.0, 0.9, 0.5, 2, "CASE7")]
    df = spark.createDataFrame(rows, "u1 double, s double, u2 double, n_sharing long, outlier_case string")
    assert [r.fold_case for r in pairs.classify_fold_change(df, outlier_case="outlier_case").collect()] == ["CASE3", "CASE6", "CASE4", "CASE3"]


# u1, s, u2, n_sharing, smallest population, z of u1, s, u2, case
OUTLIER = [
    (NAN, 1.0, 1.0, 2, 12, 0, 0, 0, "CASE5"),
    (INF, 1.0, 1.0, 2, 12, 0, 0, 0, "CASE2"),
    (INF, INF, INF, 2, 0, 0, 0, 0, "CASE4"),
    (INF, -INF, INF, 2, 0, 0, 0, 0, "CASE1"),
    (1.0, 1.0, 1.0, 2, 9, 9, 9, 9, None),
    (1.0, 1.0, 1.0, 2, 12, 4, 0, 0, "CASE3"),
    (1.0, 1.0, 1.0, 2, 12, 0, 9, 4, "CASE3"),
    (1.0, 1.0, 1.0, 3, 12, 0, 4, 0, "CASE6"),
    (1.0, 1.0, 1.0, 2, 12, 0, 4, 0, "CASE7"),
    (1.0, 1.0, 1.0, 2, 12, 0, 0, 0, "CASE0"),
]


def test_outlier_tree(spark):
    ratios = spark.createDataFrame(
        [(f"a{i:02d}", "b", "x", *case[:4]) for i, case in enumerate(OUTLIER)],
        "node_1 string, node_2 string, protein_set string, u1 double, s double, u2 double, n_sharing long",
    )
    scores = spark.createDataFrame(
        [(f"a{i:02d}", "b", "x", t, c[4], float(z)) for i, c in enumerate(OUTLIER) if c[4] for t, z in zip(("u1", "s", "u2"), c[5:8])],
        "node_1 string, node_2 string, protein_set string, test string, n_values long, modified_z double",
    )
    got = [r.outlier_case for r in pairs.classify_outlier(ratios, scores, set_key="protein_set").orderBy("node_1").collect()]
    assert got == [c[8] for c in OUTLIER]


def test_modified_z(spark):
    values = [1.0, 1.1, 0.9, 1.05, 0.95, 1.2, 0.8, 1.0, 1.15, 9.0]
    df = spark.createDataFrame([("g", v, v == 9.0) for v in values], "g string, value double, is_tested boolean")
    center = sorted(values)
    median = (center[4] + center[5]) / 2
    deviations = sorted(abs(v - median) for v in values)
    mad = (deviations[4] + deviations[5]) / 2
    row = pairs.modified_z(df, ["g"]).first()
    assert row.n_values == 10 and row.modified_z == pytest.approx(0.6745 * abs(9.0 - median) / mad)


def test_pair_fdr_guard(spark):
    df = spark.createDataFrame([("r", "CASE6")], "run string, fold_case string")
    assert math.isnan(pairs.pair_fdr(df, ["run"]).first().pair_fdr)


def test_a_hub_is_not_expanded_by_pair(spark):
    """2,000 nodes in one peptide and in a second one with one node more: two signatures, not pairs times proteins."""
    rows = [("a", f"p{i:04d}") for i in range(2000)] + [("b", f"p{i:04d}") for i in range(2001)] + [("c", "p0000"), ("c", "q"), ("d", "q"), ("d", "r")]
    links = spark.createDataFrame(rows, "peptide_node string, protein_node string")
    sets = pairs.protein_sets(links).cache()
    of_set = pairs.set_members(links, sets).cache()
    of_pair = pairs.pair_sets(of_set).cache()
    signed = pairs.sharing_signatures(of_pair, sets.filter("peptide_node = set_id").select("set_id", "n_sharing")).cache()
    assert signed.count() == 2001 * 2000 // 2 + 2
    # One pair stands for all 1,999,000 pairs that lie in both sets.
    assert pairs.expanded_signatures(signed, of_pair, of_set).count() == 4001
    counted = pairs.n_sharing(of_pair, of_set, sets).groupBy("n_sharing").count().collect()
    assert {r["n_sharing"]: r["count"] for r in counted} == {2001: 2001 * 2000 // 2, 2: 2}


def test_sharing_against_sets(spark):
    rng = random.Random(3)
    rows = sorted({(f"e{rng.randrange(40)}", f"p{rng.randrange(25)}") for _ in range(150)} | {(f"f{i}", p) for i in range(3) for p in ("p1", "p2", "p3")})
    links = spark.createDataFrame(rows, "peptide_node string, protein_node string")
    of_peptide, want = {}, {}
    for e, p in rows:
        of_peptide.setdefault(e, set()).add(p)
    for members in of_peptide.values():
        for a in members:
            for b in members:
                if a < b:
                    want.setdefault((a, b), set()).update(members)
    sets = pairs.protein_sets(links)
    of_set = pairs.set_members(links, sets)
    got = pairs.n_sharing(pairs.pair_sets(of_set), of_set, sets).collect()
    assert {(r["node_1"], r["node_2"]): r["n_sharing"] for r in got} == {k: len(v) for k, v in want.items()}
    by_protein = pairs.shared_by_protein(links).collect()
    count = {(a, b, p): sum({a, b, p} <= m for m in of_peptide.values()) for (a, b), around in want.items() for p in around}
    assert {(r["node_1"], r["node_2"], r["protein_node"]): r["n_shared_nodes"] for r in by_protein} == count


@pytest.mark.parametrize("unique_only, block", [(True, 20_000), (False, 20_000), (False, 8)])
def test_outlier_scores_in_blocks(spark, unique_only, block):
    rng = random.Random(5)
    hub = [("hub", f"p{i}") for i in range(12)]
    rows = sorted({(f"e{rng.randrange(30)}", f"p{rng.randrange(12)}") for _ in range(60)} | set(hub))
    links = spark.createDataFrame([("r", *r) for r in rows], "run string, peptide_node string, protein_node string")
    value_of = {e: [rng.gauss(0, 1) for _ in range(rng.randrange(1, 6))] + [INF] for e in {e for e, _ in rows}}
    values = spark.createDataFrame([("r", e, v) for e, vs in value_of.items() for v in vs], "run string, peptide_node string, log2_ratio double")
    of_peptide, of_protein = {}, {}
    for e, p in rows:
        of_peptide.setdefault(e, set()).add(p)
        of_protein.setdefault(p, set()).add(e)
    name = {e: min(f for f in of_peptide if of_peptide[f] == of_peptide[e]) for e in of_peptide}
    finite = lambda es: [v for e in es for v in value_of[e][:-1]]
    tests, want = [], {}
    for e in {name[e] for e in name}:
        for a in of_peptide[e]:
            for b in of_peptide[e]:
                if a < b:
                    u1, s, u2 = (rng.gauss(0, 3) for _ in range(3))
                    tests.append(("r", a, b, e, u1, s, u2))
                    own = lambda x, y: [f for f in of_protein[x] if (len(of_peptide[f]) == 1 if unique_only else y not in of_peptide[f])]
                    shared, one, two = finite([f for f in name if name[f] == e]), finite(own(a, b)), finite(own(b, a))
                    for test, x, around in (("u1", u1, shared + two), ("s", s, one + two), ("u2", u2, one + shared)):
                        population = [*around, x]
                        center = statistics.median(population)
                        mad = statistics.median(abs(v - center) for v in population)
                        want[a, b, e, test] = (len(population), 0.6745 * abs(x - center) / mad if mad > 1e-9 else 0.0)
    ratios = spark.createDataFrame([*tests, ("r", "p0", "p1", "x", NAN, 1.0, 1.0)], "run string, node_1 string, node_2 string, set_id string, u1 double, s double, u2 double")
    got = pairs.outlier_scores(ratios, links, values, ["run"], unique_only, block).collect()
    assert len(got) == len(want)
    for r in got:
        n, z = want[r["node_1"], r["node_2"], r["set_id"], r["test"]]
        assert r["n_values"] == n and r["modified_z"] == pytest.approx(z)


@pytest.mark.parametrize("unique_only", [True, False])
def test_pair_ratios_against_sets(spark, monkeypatch, unique_only):
    """Ratios, sizes and texts of random sets; only pairs of several sets look at the nodes around them."""
    rng = random.Random(11)
    rows = sorted({(f"e{rng.randrange(30)}", f"p{rng.randrange(20)}") for _ in range(70)} | {("f1", "p1"), ("f1", "p2"), ("f2", "p1"), ("f2", "p2"), ("f2", "p3")})
    links = spark.createDataFrame([("r", *r) for r in rows], "run string, peptide_node string, protein_node string")
    of_peptide = {}
    for e, p in rows:
        of_peptide.setdefault(e, set()).add(p)
    value = {e: [rng.gauss(0, 1) for _ in range(rng.randrange(1, 4))] for e in sorted(of_peptide) if e != "e3"}
    stats = spark.createDataFrame(
        [("r", e, len(v), 0, 0, 0, len(v), 0, 0, sum(v)) for e, v in value.items()],
        "run string, peptide_node string, n_values long, n_pos long, n_neg long, n_missing long, n_finite long, n_old_pos long, n_old_neg long, sum_finite double",
    )

    def mean(nodes):
        values = [v for e in nodes for v in value.get(e, [])]
        return sum(values) / len(values) if values else NAN

    want, around = {}, {}
    for members in of_peptide.values():
        for a in members:
            for b in members:
                if a < b:
                    around.setdefault((a, b), set()).update(members)
    for e, members in of_peptide.items():
        for a in members:
            for b in members:
                if a < b:
                    own = lambda x, y: [f for f, m in of_peptide.items() if x in m and (len(m) == 1 if unique_only else y not in m)]
                    same = [f for f, m in of_peptide.items() if m == members]
                    want[a, b, " ".join(sorted(members))] = (mean(own(a, b)), mean(same), mean(own(b, a)), len(around[a, b]))
    expanded = []

    def counted(of_pair, *rest, real=pairs.n_sharing):
        expanded.append({tuple(r)[:3] for r in of_pair.select("run", "node_1", "node_2").collect()})
        return real(of_pair, *rest)

    monkeypatch.setattr(pairs, "n_sharing", counted)
    got = pairs.pair_ratios(links, stats, ["run"], unique_only, texts=True).collect()
    assert len(got) == len(want)
    for r in got:
        expected = want[r["node_1"], r["node_2"], r["protein_set"]]
        assert [r["u1"], r["s"], r["u2"]] == pytest.approx(list(expected[:3]), nan_ok=True) and r["n_sharing"] == expected[3]
    times = {}
    for a, b, _ in want:
        times[a, b] = times.get((a, b), 0) + 1
    assert expanded == [{("r", *pair) for pair, n in times.items() if n > 1}] and expanded[0]
    ids = pairs.pair_ratios(links, stats, ["run"], unique_only)
    assert ids.columns == ["run", "node_1", "node_2", "set_id", "u1", "s", "u2", "n_sharing"] and ids.count() == len(want)

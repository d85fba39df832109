"""Digestion, occurrences, positions, modification rules and alignment against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from netquant.functions import sequences
from netquant.operators import align, filters, positions


@pytest.mark.parametrize(
    "text, want",
    [
        ("79.96@STY", (79.96, "STY")),
        ("+79.96@PST", (79.96, "PST")),
        ("K", (None, "K")),
        ("+79.96", (79.96, None)),
        ("-17.03@Q", (-17.03, "Q")),
    ],
)
def test_ptm_specs(text, want):
    assert sequences.parse_ptm_spec(text) == want


@pytest.mark.parametrize("text", ["", "@", "79.96@1"])
def test_bad_ptm_specs(text):
    with pytest.raises(ValueError):
        sequences.parse_ptm_spec(text)


def test_cleave(spark):
    df = spark.createDataFrame([("AAKBBRCC",), ("KKA",), ("AAA",)], "s string")
    got = [r.p for r in df.select(sequences.cleave("s").alias("p")).collect()]
    assert got == [["AAK", "BBR", "CC"], ["K", "K", "A"], ["AAA"]]
    got = [r.p for r in df.select(sequences.cleave("s", missed=2).alias("p")).collect()]
    assert got == [["AAK", "BBR", "CC", "AAKBBR", "BBRCC", "AAKBBRCC"], ["K", "K", "A", "KK", "KA", "KKA"], ["AAA"]]


def test_semi_forms(spark):
    got = spark.createDataFrame([("ABC",)], "s string").select(sequences.semi_forms("s").alias("p")).first().p
    assert sorted(got) == ["A", "AB", "ABC", "BC", "C"]


def test_occurrences(spark):
    rng = random.Random(3)
    rows = [("AAAA", "AA"), ("ABABA", "ABA"), ("XYZ", "Q"), ("ABCABC", "ABC"), ("AB", "ABC")]
    rows += [("".join(rng.choice("AB") for _ in range(40)), "".join(rng.choice("AB") for _ in range(rng.randint(1, 4)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "s string, p string").select("s", "p", sequences.occurrences("s", "p").alias("at"))
    for row in df.collect():
        assert row.at == [m.start() + 1 for m in re.finditer(f"(?={row.p})", row.s)], row


def test_covering_equals_nested_loops(spark):
    rng = random.Random(9)
    spans = [(f"p{i}", f"A{rng.randrange(4)}", s := rng.randint(1, 400), s + rng.randint(0, 150)) for i in range(80)]
    marks = [(f"A{rng.randrange(4)}", rng.randint(1, 500)) for _ in range(25)]
    got = positions.covering(
        spark.createDataFrame(spans, "peptide_key string, protein_acc string, start int, end int"),
        spark.createDataFrame(marks, "protein_acc string, protein_position int"),
    )
    want = {s for s in spans if any(acc == s[1] and s[2] <= at <= s[3] for acc, at in marks)}
    assert {tuple(r) for r in got.select("peptide_key", "protein_acc", "start", "end").collect()} == want


def test_compatible(spark):
    rows = [([3, 9], 1, 5, [3]), ([3, 9], 1, 10, [3]), ([3], 1, 5, [3, 4]), ([9], 1, 5, [])]
    df = spark.createDataFrame(rows, "state array<int>, start int, end int, own array<int>")
    got = df.select(positions.compatible(F.col("state"), F.col("start"), F.col("end"), F.col("own")).alias("c")).collect()
    assert [r.c for r in got] == [True, False, False, True]


def states_by_subsets(peptide_sets):
    """Unions of all non-empty subsets of modified peptides."""
    found = set()
    for n in range(1, len(peptide_sets) + 1):
        for chosen in itertools.combinations(peptide_sets, n):
            found.add(frozenset().union(*chosen))
    return found


def test_protein_states_equal_all_peptide_subsets(spark):
    sets = {"m1": {3}, "m2": {3, 7}, "m3": {12}, "m4": {15}}
    spans = [("m1", "A", 1, 5), ("m2", "A", 1, 9), ("m3", "A", 10, 13), ("m4", "A", 14, 20), ("u1", "A", 6, 9), ("u2", "A", 30, 40)]
    marks = [(p, "A", at, "S", 79.96) for p, places in sets.items() for at in places]
    span_df = spark.createDataFrame(spans, "peptide_key string, protein_acc string, start int, end int")
    mark_df = spark.createDataFrame(marks, "peptide_key string, protein_acc string, protein_position int, aa string, delta_mass double")
    states, edges = positions.protein_ptm_states(span_df, mark_df, mark_df)
    got = {frozenset(r.state_positions): r.state_key for r in states.collect()}
    assert set(got) == states_by_subsets(list(sets.values()))
    assert got[frozenset({3, 7})] == "A_S3(*),S7(*)"
    rows = {(r.state_key, r.peptide_key) for r in edges.collect()}
    assert (got[frozenset({3})], "m1") in rows and (got[frozenset({3, 7})], "m1") in rows
    assert (got[frozenset({12})], "u1") in rows and (got[frozenset({3, 7})], "u1") not in rows
    # m1 spans 1-5, so position 7 is outside of it; m2 needs both of its positions.
    assert (got[frozenset({3, 12})], "m2") not in rows
    assert {p for s, p in rows if s is None} == {"u1", "u2"}
    few, rest = positions.protein_ptm_states(span_df, mark_df, mark_df, max_ptms=3)
    assert few.count() == 0 and rest.filter("state_key is null").count() == 6


def test_keep_ptm(spark):
    rows = [("p1", [("S", 79.96)]), ("p2", [("K", 79.96)]), ("p3", [("S", 42.01)]), ("p4", [])]
    df = spark.createDataFrame(rows, "peptide_key string, ptms array<struct<aa:string,delta_mass:double>>")
    keep = lambda text: sorted(r.peptide_key for r in filters.keep_ptm(df, sequences.parse_ptm_specs(text)).collect())
    assert keep("79.96@STY") == ["p1"] and keep("+79.96") == ["p1", "p2"] and keep("S") == ["p1", "p3"] and keep("K, 42.01") == ["p2", "p3"]


def best_alignment(a, b):
    """Best affine-gap score by plain dynamic programming over three states."""
    low = -(10**6)
    table = align.substitution_table()
    m = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    x = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    y = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    m[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                s = int(table[ord(a[i - 1]) - 65, ord(b[j - 1]) - 65])
                m[i][j] = s + max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1])
            if i:
                x[i][j] = max(m[i - 1][j] - 11, x[i - 1][j] - 1, y[i - 1][j] - 11)
            if j:
                y[i][j] = max(m[i][j - 1] - 11, y[i][j - 1] - 1, x[i][j - 1] - 11)
    return max(m[-1][-1], x[-1][-1], y[-1][-1])


def near_copies(seed, roots, copies):
    rng = random.Random(seed)
    words = set()
    for _ in range(roots):
        word = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(12, 24)))
        words.add(word)
        for _ in range(copies):
            letters = list(word)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(letters))
                edit = rng.random()
                if edit < 0.5:
                    letters[k] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
                elif edit < 0.75:
                    del letters[k]
                else:
                    letters.insert(k, rng.choice("ACDEFGHIKLMNPQRSTVWY"))
            words.add("".join(letters))
    return sorted(words)


def test_alignment_scores():
    words = near_copies(2, 6, 3)
    pairs = list(itertools.combinations(words, 2))
    got = align.align_batch([p[0] for p in pairs], [p[1] for p in pairs])
    assert [int(row[0]) for row in got] == [best_alignment(a, b) for a, b in pairs]
    same = align.align_batch(["PEPTIDEK"], ["PEPTIDEK"])[0]
    assert list(same[1:]) == [8, 8, 8]


@pytest.mark.parametrize("hot", [1000, 3])
def test_alignment_misses_no_pair(spark, hot):
    words = near_copies(5, 15, 5)
    pairs = list(itertools.combinations(words, 2))
    found = align.align_batch([p[0] for p in pairs], [p[1] for p in pairs])
    want = {p for p, (s, same, n, run) in zip(pairs, found) if s >= 30 and same / n >= 0.8 and run >= 6}
    df = spark.createDataFrame([(w,) for w in words], "peptide_key string")
    got = {(r.peptide_1, r.peptide_2) for r in align.align_peptides(df, hot=hot).collect()}
    assert got == want and len(want) > 20


def test_signs_in_peptides_are_letters(spark):
    df = spark.createDataFrame([("AB*CK*CK", "*CK"), ("A.AXA", "A.A"), ("****", "**"), ("AXA", "A.A")], "s string, p string")
    got = [r.o for r in df.select(sequences.occurrences("s", "p").alias("o")).collect()]
    assert got == [[3, 6], [1], [1, 2, 3], []]


def test_states_of_more_masses_than_symbols_stay_apart(spark):
    masses = [float(m) for m in range(10, 19)]
    rows = [(f"P{k}", "A" if k in (0, 8) else f"B{k}", 3 * k + 1, 3 * k + 3, m) for k, m in enumerate(masses)]
    spans = spark.createDataFrame([r[:4] for r in rows], "peptide_key string, protein_acc string, start int, end int")
    placed = spark.createDataFrame(
        [(r[0], r[1], 1, "S", r[4], r[2]) for r in rows],
        "peptide_key string, protein_acc string, position int, aa string, delta_mass double, protein_position int",
    )
    states, edges = positions.protein_ptm_states(spans, placed, placed.select("peptide_key"))
    keys = [r.state_key for r in states.filter("protein_acc = 'A'").collect()]
    assert sorted(keys) == ["A_S1(*)", "A_S1(*),S25(9)", "A_S25(9)"]
    found = {(r.state_key, r.peptide_key) for r in edges.filter("protein_acc = 'A'").collect()}
    assert found == {("A_S1(*)", "P0"), ("A_S1(*),S25(9)", "P0"), ("A_S1(*),S25(9)", "P8"), ("A_S25(9)", "P8")}
    with pytest.raises(ValueError):
        positions.protein_ptm_states(spans, placed, placed.select("peptide_key"), max_ptms=31)


def test_protein_occurrences_equal_a_search_at_every_place(spark):
    rng = random.Random(5)
    texts = {f"P{k}": "".join(rng.choice("AK*") for _ in range(200)) for k in range(4)} | {"E": ""}
    edges = {(t[i : i + n], acc) for acc, t in texts.items() for i in range(0, 190, 7) for n in (1, 2, 3, 4, 5, 9) if t}
    want = {(p, acc, i + 1, i + len(p)) for p, acc in edges for i in range(200) if texts[acc].startswith(p, i)}
    found = positions.protein_occurrences(
        spark.createDataFrame(sorted(edges), "peptide_key string, protein_acc string"),
        spark.createDataFrame([*texts.items(), ("N", None)], "protein_acc string, sequence string"),
    ).collect()
    assert len(found) == len(want) and {(r.peptide_key, r.protein_acc, r.start, r.end) for r in found} == want


def test_an_occurrence_moves_neither_by_a_join_nor_by_a_window(spark):
    """Sequence and peptides of a protein meet once; a protein of several rows is counted through, as before."""
    proteins = spark.createDataFrame([("A", "GAKAKRCK"), ("A", "GAKAKRCK"), ("B", "RRK"), ("C", None)], "protein_acc string, sequence string")
    edges = spark.createDataFrame([("AK", "A"), ("K", "B"), ("AK", "A"), ("AKA", "A"), ("AK", None)], "peptide_key string, protein_acc string")
    found = positions.protein_occurrences(edges, proteins)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(
        [("AK", "A", 2, 3), ("AK", "A", 5, 6), ("AK", "A", 7, 8), ("AK", "A", 9, 10), ("AKA", "A", 2, 4), ("AKA", "A", 2, 4), ("K", "B", 3, 3)]
    )


def test_candidate_pairs_are_not_shuffled(spark):
    """Pairs of a k-mer grow with its square: they are tested where the index rows meet, only passing ones move on."""
    words = spark.createDataFrame([("ACDEFGHIKL",), ("ACDEFGHIKM",), ("WWACDEFGHI",)], "peptide_key string")
    found = align.candidate_pairs(words, hot=2)
    tree = found._jdf.queryExecution().executedPlan().toString()
    top = tree[: tree.index("Join")]
    assert "Exchange" not in top and "Aggregate" not in top
    assert {tuple(r) for r in found.collect()} == {("ACDEFGHIKL", "ACDEFGHIKM")}


@pytest.mark.parametrize("hot", [1000, 4])
def test_stretches_hold_the_pairs_of_the_join(spark, monkeypatch, hot):
    """Rows of a crowded k-mer meet at the places that the gaps allow; the pairs are those of the join of all its rows."""
    rng = random.Random(11)
    words = [("".join(rng.choice("AB") for _ in range(rng.randint(6, 30))),) for _ in range(120)] + [(w,) for w in near_copies(7, 6, 4)]
    df = spark.createDataFrame(words, "peptide_key string").repartition(3)
    found = []
    for few in (10**6, 0):
        monkeypatch.setattr(align, "FEW", few)
        found.append(sorted(tuple(r) for r in align.candidate_pairs(df, hot=hot).collect()))
    assert found[0] == found[1] and len(set(found[0])) > 50


def test_only_near_places_are_tested(spark, monkeypatch):
    """A k-mer that all peptides hold at other places costs no pair."""
    words = [("".join(chr(65 + (i + k) % 20) for k in range(i)) + "WWWWWW" + "".join(chr(65 + (i * 7 + k) % 20) for k in range(60 - i)),) for i in range(0, 60, 2)]
    df = align.sketched(spark.createDataFrame(words, "peptide_key string"))
    at = F.instr("peptide_key", "WWWWWW")
    rows = df.select(F.lit("WWWWWW").alias("gram"), F.lit(-1).alias("band"), F.lit(-1).alias("own"), "peptide_key", "n", at.alias("at"), F.lit("").alias("before"), "bag", "two_1", "two_2")
    looked = []
    repeat = align.np.repeat
    monkeypatch.setattr(align.np, "repeat", lambda a, n: looked.append(int(align.np.sum(n))) or repeat(a, n))
    list(align.neighbours(rows.toArrow(), 0.9))
    assert 0 < sum(looked) < 30 * 29 / 2 / 3


def test_pairs_with_too_many_edits_are_not_aligned(spark):
    pairs = spark.createDataFrame([("AAAABBBBCCCC", "AAAABBBBCCCC"), ("AAAABBBBCCCC", "AAAABBBBCC"), ("AAAABBBBCCCC", "CCCCBBBBAAAA")], "peptide_1 string, peptide_2 string")
    assert [r.peptide_2 for r in align.near_enough(pairs, 0.8).collect()] == ["AAAABBBBCCCC", "AAAABBBBCC"]
    assert align.near_enough(pairs, 0).count() == 3


def test_long_alignments():
    rng = random.Random(4)
    a = "".join(rng.choice("ACDEFGHIK") for _ in range(300))
    b = a[:100] + "WW" + a[104:250] + "Y" + a[251:]
    got = align.align_batch([a, "PEPTIDEK"], [b, "PEPTIDK"])
    assert [int(row[0]) for row in got] == [best_alignment(a, b), best_alignment("PEPTIDEK", "PEPTIDK")]

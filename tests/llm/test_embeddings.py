import math

import numpy as np
import pytest

from netquant.llm import embeddings, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, rep long"


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    links = {i: set() for i in ids}
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine:
                    links[ids[a]].add(ids[b])
                    links[ids[b]].add(ids[a])
    component = {}
    for i in sorted(ids):
        if i not in component:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in component:
                    component[j] = i
                    todo += links[j]
    return {i: (len(links[i]), component[i], component[i] == i) for i in ids}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def planted(seed, n=300, size=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    rows = [base[k] for k in range(n)]
    for k in range(12):  # groups around one vector, chains, copies, multiples
        rows += [base[k] + rng.normal(size=size) * s for s in np.linspace(0.05, 0.5, 25)]
        rows += [base[k]] * 3 + [base[k] * 4]
    step = base[20]
    for _ in range(20):
        step = step + rng.normal(size=size) * 0.42
        rows.append(step)
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 1, np.asarray(rows[k], np.float32).tolist()) for i, k in enumerate(order)]


@pytest.mark.parametrize("slab, width, size", [(6000, 16, 64), (50, 16, 64), (40, 8, 30), (100, 16, 3)])
def test_against_all_pairs(spark, monkeypatch, slab, width, size):
    monkeypatch.setattr(embeddings, "SLAB", slab)
    monkeypatch.setattr(embeddings, "STEP", 64)
    rows = planted(slab, size=size)
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    assert result(embeddings.near_duplicates(df, width=width)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]),
            (10, [3.0]), (11, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1e30, 1e25]), (14, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    assert result(embeddings.near_duplicates(df)) == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_op5_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(queries.op5(spark, SF)) == brute(rows)


@pytest.mark.parametrize("chunk", [37, 1000])
def test_vectors_are_not_copied_to_a_shuffle(spark, monkeypatch, chunk):
    """Chunks of any size give the same links, and no vector is exchanged to meet another one."""
    plans, write = [], embeddings.cut

    def kept(df, label="cut"):
        if "links" in label:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(embeddings, "cut", kept)
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = planted(3, n=60)
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    assert result(embeddings.near_duplicates(df)) == brute(rows)
    assert len(plans) > 1 and not any("Exchange" in plan for plan in plans)

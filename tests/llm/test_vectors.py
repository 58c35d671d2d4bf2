import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import op3_graph, op9_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"
ODD = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [math.nan] * 8), (1004, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (1005, [0.5]), (1006, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def clusters(n, dims=8, seed=0):
    r = np.random.RandomState(seed)
    x = r.randn(20, dims)[r.randint(0, 20, n)] + 0.3 * r.randn(n, dims)
    return [(i, v) for i, v in enumerate(x.astype("f4").tolist())]


def run(f, df, **k):
    rows = f(df, df.where(F.col("vec_id") % 50 == 0), **k).collect()
    out = {}
    for x in sorted(rows, key=lambda x: (x.query_id, x["rank"])):
        out.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert x["rank"] == len(out[x.query_id])
    return out


def test_top_k_against_brute_force(spark):
    rows = clusters(700) + [(2000 + i, [0.1] * 8) for i in range(8)] + ODD
    got = run(op9_topk.top_k, frame(spark, rows), chunk=128)
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q, a in ok:
        if q % 50 == 0:
            want = sorted(((-dot(a, b), i) for i, b in ok if i != q))[:5]
            assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got


def test_top_k_large_numbers_and_small_tables(spark):
    df = frame(spark, [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])])
    assert run(op9_topk.top_k, df) == {0: [(1, (1 << 63) - 1), (3, (1 << 63) - 1), (2, -(1 << 63))]}
    assert run(op9_topk.top_k, df.where("vec_id = 0")) == {} == run(op9_topk.top_k, df.limit(0))


def test_top_k_is_the_sql(spark):
    df = frame(spark, clusters(300, 64))
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toPandas())
    want = {}
    for q, n, i, s in sorted(con.execute(op9_topk.OP9_SQL).fetchall()):
        want.setdefault(q, []).append((i, s))
    assert run(op9_topk.top_k, df) == want


def cosines(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max(len(v) for _, v in ok)
    m = np.array([np.pad(v, (0, dims - len(v))) for _, v in ok])
    m /= np.sqrt((m * m).sum(1))[:, None]
    return np.array([i for i, _ in ok]), m


def test_graph_recall(spark):
    rows = clusters(6000, 24) + ODD
    got = run(op3_graph.search, frame(spark, rows), shard=2000)
    ids, m = cosines(rows)
    hit = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = m @ m[k]
        s[k] = -9
        top = ids[np.lexsort((ids, -s))[:5]]
        found = got.pop(int(ids[k]))
        assert len(found) == 5 and all(abs(x - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, x in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hit += len(set(top.tolist()) & {i for i, _ in found})
        total += 5
    assert not got and hit / total >= 0.95


def test_graph_small_tables_and_ties(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [5.0, 0.0]), (4, [0.0, 1.0]), (1000, None)])
    assert run(op3_graph.search, df) == {0: [(3, 1.0), (7, 1.0), (4, 0.0)]}
    assert run(op3_graph.search, df.limit(0)) == {}


@pytest.mark.parametrize("n", [80, 1500])
def test_graph_degrees_and_reach(n):
    x = np.array([v for _, v in clusters(n, 16)], np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    g = op3_graph.Graph(x)
    assert (g.n_next <= 2 * op3_graph.DEGREE).all() and all(i not in g.next[i] for i in range(n))
    seen, todo = {g.start}, [g.start]
    while todo:
        for j in g.next[todo.pop()]:
            if j >= 0 and int(j) not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) >= 0.999 * n


def test_repeated_and_reordered_rows_are_candidates_each(spark):
    rows = clusters(60)
    random.Random(1).shuffle(rows)
    one = run(op9_topk.top_k, frame(spark, rows))
    two = run(op9_topk.top_k, frame(spark, rows + rows))
    assert all([i for i, _ in two[q]][::2] == [i for i, _ in one[q]][:3] for q in one)


def test_graph_recall_with_copies(spark):
    r = np.random.RandomState(3)
    some = r.randn(2000, 24).astype("f4").tolist()
    hub, other = some[0], r.randn(24).astype("f4").tolist()
    rows = [(int(i), v) for i, v in zip(r.permutation(3000), [*some, *[hub] * 900, *[other] * 100])]
    rows += [(i, [2 * x for x in v]) for i, v in rows[1990:2020]] + [(i, v) for i, v in rows[1995:2010]]
    got = run(op3_graph.search, frame(spark, rows), shard=4000)
    ids, m = cosines(rows)
    exact = {i: np.array(v) for i, v in rows}
    hit = total = 0
    for q in sorted(got):
        a = exact[q] / np.sqrt((exact[q] ** 2).sum())
        s = np.round(m @ a, 12)
        s[ids == q] = -9
        top = np.lexsort((ids, -s))[:5]
        hit += sum((Counter(ids[top].tolist()) & Counter(i for i, _ in got[q])).values())
        total += 5
        if exact[q].tolist() in (hub, other):
            assert [i for i, _ in got[q]] == ids[top].tolist()
    assert total == 300 and hit / total >= 0.95


def test_members_hold_the_least_of_each_vector():
    r = np.random.RandomState(4)
    vector = r.randint(0, 12, 400)
    node, ids = vector // 2, r.randint(0, 30, 400)
    rows, starts = op3_graph.members(node, vector, ids, 3)
    assert len(rows) <= 12 * 4 * 3
    for g in range(6):
        part = rows[starts[g] : starts[g + 1]]
        assert (node[part] == g).all()
        for v in (2 * g, 2 * g + 1):
            for own in range(30):
                least = lambda at: sorted(ids[at][(vector[at] == v) & (ids[at] != own)])[:3]
                assert least(part) == least(np.arange(400))


def test_numbers_at_the_ends_of_doubles(spark):
    rows = [(0, [1e-170, 2e-170]), (1, [3e-170, 6e-170]), (2, [1e306, 2e306]), (50, [1.5e308, -1e300]), (3, [0.0, -1.0]), (4, [5e-324, 0.0]), (5, [0.0, 0.0]), (6, [-1.7e308, 1.7e308])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA.replace("array<float>", "array<double>"))
    whole = lambda v: [math.floor(Fraction(x) * 256) for x in v]
    held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    dot = {q: sorted(((-held(sum(a * b for a, b in zip(whole(v), whole(w)))), i) for i, w in rows if i != q))[:5] for q, v in rows if q % 50 == 0}
    assert run(op9_topk.top_k, df) == {q: [(i, -s) for s, i in x] for q, x in dot.items()}
    got = run(op3_graph.search, df)

    def cosine(v, w):
        v, w = [Fraction(x) for x in v], [Fraction(x) for x in w]
        big = lambda x: max(map(abs, x))
        v, w = [float(x / big(v)) for x in v], [float(x / big(w)) for x in w]
        return sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w)

    for q, v in rows:
        if q % 50 == 0:
            want = {i: cosine(v, w) for i, w in rows if i not in (q, 5)}
            assert len(got[q]) == 5 and all(abs(want[i] - s) < 1e-12 for i, s in got[q])
            assert min(s for _, s in got[q]) >= sorted(want.values())[-5] - 1e-12


def test_scaling_changes_no_bit_of_a_score():
    r = np.random.RandomState(5)
    a, b = r.randn(200, 16) * 1000, r.randn(200, 16) / 999
    score = lambda v, w: (v * w).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((w * w).sum(1)))
    assert (score(a, b) == score(op3_graph.scaled(a), op3_graph.scaled(b))).all()

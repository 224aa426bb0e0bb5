import numpy as np
import pytest

from lodestone.llm import pivot_index as P
from lodestone.llm.queries import op9_pivot_index

SF = "/root/testdata/sf0.001"


def brute(rows, least=0.93):
    """Links of each row and the smallest id that it reaches."""
    n = len(rows)
    linked = np.zeros((n, n), bool)
    sound = [
        label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows
    ]
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and sound[i] and sound[j] and la == lb and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                linked[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least
    label = np.arange(n)
    for _ in range(n):
        label = np.minimum(label, np.where(linked, label[None], n).min(axis=1))
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], int(linked[i].sum()), min(ids) if ids else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, copies int")


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(op9_pivot_index(spark, SF)) == brute(rows)


@pytest.mark.parametrize("piece", [P.PIECE, 10])
def test_groups_and_recall(spark, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    rng = np.random.default_rng(3)
    rows = []
    for group in range(12):
        centre = rng.normal(size=32)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(size=32) * 0.22).astype(np.float32).tolist(), group % 3))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    got, want = found(P.near_duplicate_vectors(table(spark, rows))), brute(rows)
    links = sum(w[1] for w in want)
    assert links > 2000 and 0.9 <= sum(g[1] for g in got) / links <= 1
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0),
        (8, [nan, 1.0], 0), (9, [1.0, inf], 0), (10, [1.0, None], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.01, 0.0], 0), (None, [3.0, 0.1], 0),
        (13, [1.0, 0.0], 0), (13, [1.0, 0.0], 0), (14, [3e38, 3e36], 0), (15, [1e-44, 0.0], 0), (16, [-1.0, 0.0], 0), (None, None, None),
    ]
    assert found(P.near_duplicate_vectors(table(spark, rows))) == brute(rows)
    assert P.near_duplicate_vectors(table(spark, rows).filter("false")).collect() == []


def test_dimension_with_one_reference_point(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=3)
    rows = [(i, (base + rng.normal(size=3) * 0.02 * (i % 4)).tolist(), 1) for i in range(12)]
    monkeypatch.setattr(P, "choose_pivots", lambda nodes, n: {3: P.unit_rows(P.pa.array([rows[5][1]], P.pa.list_(P.pa.float64())))})
    table_ = table(spark, rows)
    want = brute([(r.vec_id, r.embedding, r.label) for r in table_.collect()])
    assert any(n for _, n, _ in want) and found(P.near_duplicate_vectors(table_)) == want

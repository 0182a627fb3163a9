"""Exact ranks of vectors by matrices, against scores of all pairs one by one."""

import math

import duckdb
import numpy as np
import pytest

from rankweave.operators import dense
from rankweave.plans import catalog


def vectors(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def by_pairs(found, asked, k, score):
    """(qid, id, rank) of lists of pairs; pairs without a score come last, NaN first."""

    def of(q, x):
        if len(q) != len(x) or None in q or None in x:
            return None
        total = 0.0
        for a, b in zip(q, x):
            total += a * b if score is dense.dot else abs(a - b)
        total = total if score is dense.dot else -total
        return total if math.isnan(total) or math.isinf(total) else round(total, 6)

    out = set()
    for qid, q in asked:
        if q is not None:
            scored = [(of(q, x), key) for key, x in found if x is not None]
            order = sorted(scored, key=lambda p: (p[0] is None, p[0] is not None and not math.isnan(p[0]), -p[0] if p[0] is not None and not math.isnan(p[0]) else 0.0, p[1]))
            out |= {(qid, key, rank) for rank, (_, key) in enumerate(order[:k], 1)}
    return out


@pytest.mark.parametrize("score", [dense.dot, dense.nearness], ids=["dot", "nearness"])
def test_odd_vectors_and_copies(spark, monkeypatch, score):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.normal(size=4).round(1)]) for k in range(60)]
    rows += [(k, rows[7][1]) for k in range(60, 90)] + [(k, [float(v) for v in rng.normal(size=4) * 1e-7]) for k in range(90, 120)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 0.0, 0.0]), (204, [1e30, 0.0, 0.0, -1e30]), (205, [math.nan, 0.0, 0.0, 1.0]), (206, [math.inf, 1.0, 1.0, 1.0])]
    asked = [rows[k] for k in (0, 7, 95)] + [(300, None), (301, [2.0, 1.0]), (302, [None, 1.0, 1.0, 1.0]), (303, []), (304, [math.nan, 1.0, 1.0, 1.0]), (305, [1e20, 1.0, 1.0, 1.0])]
    monkeypatch.setattr(dense, "LEAST_BLOCK", 40)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    for k in (3, 50):
        got = dense.dense_rank(vectors(spark, rows), vectors(spark, asked, "qid"), k, score).select("qid", "id", "rank").collect()
        assert set(map(tuple, got)) == by_pairs(rows, asked, k, score) and len(got) == len(set(got))
    assert dense.dense_rank(vectors(spark, rows), vectors(spark, asked, "qid"), 0, score).count() == 0


def test_other_scores_are_compared_pair_by_pair(spark):
    rows = [(1, [1.0, 0.0]), (2, [5.0, 5.0]), (3, [0.0, 0.0])]
    got = dense.dense_rank(vectors(spark, rows), vectors(spark, [(9, [2.0, 1.9])], "qid"), 3, dense.cosine).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 3] and got[2].score is None


def ranked(spark, tmp_path, name):
    """The plan of a query over 1,500 vectors of which 30 are copies, after its rows were compared with its SQL."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.normal(size=16).astype(np.float32)], 0) for k in range(1500)]
    rows[700:730] = [(k, rows[100][1], 0) for k in range(700, 730)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    relation = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in relation.description]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(relation.fetchall())
    return found._jdf.queryExecution().executedPlan().toString()


def test_dense_topk_meets_in_blocks(spark, tmp_path):
    assert "NestedLoopJoin" not in ranked(spark, tmp_path, "dense_topk")


def test_facet_orders_rank_once(spark, tmp_path):
    plan = ranked(spark, tmp_path, "facet_orders")
    assert "NestedLoopJoin" not in plan and "CoGroups" not in plan


def test_evidence_selection_ranks_once(spark, tmp_path):
    plan = ranked(spark, tmp_path, "evidence_selection")
    assert "NestedLoopJoin" not in plan and "CoGroups" not in plan


def test_rrf_fusion_meets_in_blocks(spark, tmp_path):
    assert "NestedLoopJoin" not in ranked(spark, tmp_path, "rrf_fusion")


def test_first_hits_meet_in_blocks(spark, tmp_path):
    assert "NestedLoopJoin" not in ranked(spark, tmp_path, "first_hits")

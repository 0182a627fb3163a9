"""Equal boxes and areas are counted before they meet."""

import duckdb

from rankweave.plans import corpus
from rankweave.plans.registry import ORACLE_SQL
from rankweave.sources.documents import contained, contained_counts


def joined(node) -> list[int]:
    """Rows out of every join of an executed plan, stages of adaptive plans included."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined(node.executedPlan())
    below = node.children()
    inner = [node.plan()] if name.endswith("QueryStageExec") else [below.apply(k) for k in range(below.size())]
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for child in inner for n in joined(child)]


def test_equal_boxes_and_areas_meet_once(spark, tmp_path):
    """500 copies of each of 40 line items and 50 of each of 40 suppliers."""
    spark.range(40 * 500).selectExpr("(id % 40) + 800 * (id div 40) AS l_orderkey", "600 * (id div 40) + id % 40 AS l_partkey", "1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40 * 50).selectExpr("(id % 40) + 2000 * (id div 40) AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    expected = sorted(con.execute(ORACLE_SQL["contained_boxes"]).fetchall())
    found = corpus.contained_boxes(spark, str(tmp_path)).select("page", "area", "n", "least")
    assert sorted(map(tuple, found.collect())) == expected and sum(r[2] for r in expected) > 20_000
    assert 0 < max(joined(found._jdf.queryExecution().executedPlan())) <= 40 * 50


def test_counts_are_those_of_the_pairs(spark):
    columns = "page int, {} int, x0 double, top double, x1 double, bottom double"
    boxes = spark.createDataFrame([(p, k, float(k % 7 * 10), float(k % 5 * 9), float(k % 7 * 10 + 4), float(k % 5 * 9 + 4)) for k in range(60) for p in (0, 1)] + [(0, 99, None, 1.0, 2.0, 3.0)], columns.format("box"))
    areas = spark.createDataFrame([(0, 1, 0.0, 0.0, 30.0, 30.0), (0, 2, 0.0, 0.0, 30.0, 30.0), (0, 2, 0.0, 0.0, 70.0, 50.0), (1, 3, -9.0, -9.0, 5.0, 200.0), (2, 4, 0.0, 0.0, 70.0, 50.0), (0, 5, 1.0, None, 2.0, 3.0)], columns.format("area"))
    pairs: dict = {}
    for r in contained(boxes, areas).collect():
        pairs.setdefault((r.page, r.area), []).append(r.box)
    counts = {(r.page, r.area): (r.n, r.least) for r in contained_counts(boxes, areas).collect()}
    assert counts == {k: (len(v), min(v)) for k, v in pairs.items()} and set(counts) == {(0, 1), (0, 2), (1, 3)}

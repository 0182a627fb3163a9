"""retrieval_failures asks with whole items, not with their beginnings."""

import duckdb

from rankweave.plans import catalog

START = "shared opening words of"


def test_items_are_asked_whole(spark, tmp_path):
    items = [(1, f"{START} many texts, then zebra quartz lantern"), (2, "plain words here")]
    documents = [
        (1, f"{START} {START}"),  # before document 2 by the first twenty characters of item 1 alone
        (2, f"{items[0][1]} and a longer tail that no other text has at all"),
        (3, "plain plain words words here"),  # before document 4 by the whole item 2, which it doesn't hold
        (4, f"{items[1][1]} in a text that goes on for long with other things that nobody asks for"),
        *[(k, f"filler number {k} about nothing") for k in range(5, 12)],
    ]
    spark.createDataFrame([(d, t, "en") for d, t in documents], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    expected = [(2, 2)]
    assert con.execute(catalog.ORACLE_SQL["retrieval_failures"]).fetchall() == expected
    assert [tuple(r) for r in catalog.QUERIES["retrieval_failures"](spark, str(tmp_path)).collect()] == expected

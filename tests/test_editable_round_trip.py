"""Lines of editable pages lose their outer spaces and nothing else."""

import duckdb

from rankweave.plans import corpus
from rankweave.plans.registry import ORACLE_SQL

TEXTS = [(1, "0 first 0\n 1 second 1 \n\n2 third 12", "en"), (2, "407237482949640", "de"), (3, "  a\nb1\n  \nc ", "es"), (11, "00", "zh")]


def test_digits_at_the_ends_of_lines_stay(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").selectExpr("*", "'web' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus.editable_round_trip(spark, str(tmp_path)).select("page", "text", "n_rows", "cells", "is_toc").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLE_SQL["editable_round_trip"]).fetchall())
    assert {r.page: r.text for r in found}[1] == "0 first 0\n1 second 1\n2 third 12"

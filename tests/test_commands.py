import json

from rankweave.__main__ import main


def test_commands_over_files(spark, tmp_path):
    book = "# book\n\n<!-- page 1 cover -->\n\ntitle\n\n<!-- page 2 -->\n\n第一章 总则\n第一节 年假\n1.1 年假天数 员工每年有五天年假，入职满一年后开始计算，未休完的可以结转到下一年度使用。\n\n| 年 | 天 |\n| --- | --- |\n| 1 | 5 |\n\n<!-- page 3 -->\n\n第二章 考勤\n迟到三次记过一次。\n第三章 培训\n每年两次培训。\n"
    (tmp_path / "book.md").write_text(book, encoding="utf-8")
    index = str(tmp_path / "index")
    assert main(["ingest", "--index", index, "--source", str(tmp_path / "book.md")], spark).startswith("| n_chunks |")
    n = spark.read.parquet(index).count()
    main(["ingest", "--index", index, "--source", str(tmp_path / "book.md"), "--append"], spark)
    assert spark.read.parquet(index).count() == n == 4
    assert "迟到三次" in main(["ask", "--index", index, "--question", "迟到 记过"], spark)
    gold = next(r.id for r in spark.read.parquet(index).collect() if "迟到" in r.text)
    cases = [{"qid": "a", "question": "迟到记过", "gold_chunk_ids": [gold], "type": "fact", "reviewed": False}, {"qid": "b", "question": "股票", "gold_chunk_ids": [], "type": "negative", "reviewed": True}]
    (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, cases)))
    text = main(["evaluate", "--index", index, "--cases", str(tmp_path / "cases.jsonl"), "--k", "1", "3"], spark)
    assert "| 1 | 1 | 1.0000 | 1.0000 | 1.0000 | 1.0000 | 1.0000 |" in text and "| a |" in text
    (tmp_path / "red.jsonl").write_text(json.dumps({"rid": "r", "risk": "high", "expect": "escalate"}))
    (tmp_path / "answers.jsonl").write_text(json.dumps({"rid": "r", "answer": "请咨询HR〔第3页·第二章 考勤〕", "seconds": 1.0}))
    assert "| high | 1 | 1 | 1.0000 | 1 | 0 | 0 | 0 |" in main(["screen", "--index", index, "--cases", str(tmp_path / "red.jsonl"), "--answers", str(tmp_path / "answers.jsonl")], spark)

import pytest
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import checks, context, experiment, fusion, generate, metrics, perturb
from rankweave.operators.lexical import build_index, tokens
from rankweave.operators.retrieve import lexical_ranker, neighbours, retrieve, valid_requests
from rankweave.streaming import incremental


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).head()[0]


def picks(spark, fused, facets, k):
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return spark.range(1).select(fusion.selected(arr(fused), F.array(*map(arr, facets)), k)).head()[0]


def test_evidence_selection_examples(spark):
    fused = [*"abcdefgh", "salary"]
    got = picks(spark, fused, [list("abcd"), ["salary", "a"]], 8)
    assert "salary" in got and got[:3] == ["a", "b", "c"] and len(got) == 8
    assert len(set(picks(spark, list("abc"), [["a", "b"], ["a", "c"]], 2))) == 2
    assert picks(spark, [], [["a"], ["b"]], 8) == [] and picks(spark, list("abc"), [list("cba")], 2) == ["a", "b"] and picks(spark, list("abc"), [["a"], ["b"]], 0) == []


def test_lexical_anchor_goes_first(spark):
    ranks = [("q", 1, "dense", 2, "shared1", 1), ("q", 1, "dense", 2, "shared2", 2), ("q", 1, "bm25", 3, "unique", 1), ("q", 1, "bm25", 3, "shared2", 2), ("q", 1, "bm25", 3, "shared1", 3)]
    df = spark.createDataFrame(ranks, "qid string, query_no int, channel string, channel_no int, id string, rank int")
    assert [r.id for r in fusion.facet_orders(df, guarded=True).orderBy("facet_rank").collect()][0] == "unique"
    assert [r.id for r in fusion.facet_orders(df).orderBy("facet_rank").collect()] == ["shared1", "shared2", "unique"]


def test_query_expansion(spark):
    ask = lambda q, s="expanded": one(spark, fusion.query_list(F.col("q"), s), q=q)
    assert ask("  ") == [] and ask("上班时间") == ["上班时间"]
    assert ask("病假工资怎么算")[1] == "病假 薪酬 全薪 半薪 福利病假" and len(ask("病假工资怎么算")) == 3
    assert ask("事假扣工资吗")[1] == "事假 无薪假 薪酬 福利" and ask("离职工资何时结算")[1:] == ["发薪时间 发薪日 薪酬核算周期", "离职工资 交接 结算"]
    assert ask("试用期迟到怎么办", "guarded") == ["试用期迟到怎么办", "试用期 迟到 早退 不符合录用条件"] and len(ask("试用期迟到怎么办")) == 3
    assert ask(" 病假 ", "baseline") == ["病假"]
    with pytest.raises(ValueError):
        ask("x", "other")


def test_retrieval_end_to_end(spark):
    corpus = spark.createDataFrame([("c1", 1, "病假 薪酬 全薪"), ("c2", 2, "入职 转正 福利病假天数"), ("c3", 3, "年假 规定"), ("c4", 4, "工资 发薪日")], "id string, pos int, text string")
    lexical = lexical_ranker(build_index(corpus, han_bigrams=True))
    queries = spark.createDataFrame([("q1", "病假工资"), ("q2", "  "), ("q3", "<script>'; DROP \x00")], "qid string, text string")
    for strategy in fusion.STRATEGIES:
        hits = retrieve(queries, corpus, lexical=lexical, mode="bm25", strategy=strategy, k=3).orderBy("qid", "rank").collect()
        assert {h.qid for h in hits} == {"q1"} and [h.rank for h in hits] == list(range(1, len(hits) + 1)) and hits[0].dense_rank is None
    with pytest.raises(ValueError):
        retrieve(queries, corpus, lexical=lexical, mode="other")


def test_tokens(spark):
    assert one(spark, tokens(F.col("t"), True), t="年假15天 Annual-leave 假") == ["年假", "15", "天", "annual", "leave", "假"]
    assert one(spark, tokens(F.col("t")), t="A b, B!") == ["a", "b", "b"] and one(spark, tokens(F.lit(None).cast("string")), t="") == []


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([("q1", "a", 1), ("q1", "x", 2), ("q1", "b", 3), ("q2", "y", 1), ("q3", "z", 2)], "qid string, id string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "n"), ("q4", "m"), ("q3", "z")], "qid string, id string")
    per = {(r.qid, r.k): r for r in metrics.per_query(metrics.judged(hits, gold), (1, 3)).collect()}
    assert per["q1", 1].recall == 0.5 and per["q1", 3].recall == 1 and per["q1", 3].precision == pytest.approx(2 / 3) and per["q1", 1].rr == 1
    assert per["q1", 3].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / 1.5849625)) and per["q3", 3].rr == 0.5 and per["q4", 3].rr == 0 and per["q2", 3].hit == 0
    assert {r.qid: r.first_rank for r in metrics.failures(metrics.judged(hits, gold), 1).collect()} == {"q2": None, "q3": 2, "q4": None}
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert spark.range(1).select(metrics.coverage(arr("ab"), arr("ab")), metrics.coverage(arr("a"), arr("ab")), metrics.coverage(arr("a"), arr(""))).head() == (True, False, None)


def test_evidence_context_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([("q", 1, "big", 1, "", "x" * 6001), ("q", 2, "small", 2, "章", "y")], "qid string, rank int, id string, page int, path string, text string")
    row = context.evidence_context(hits).head()
    assert row.source_map == {"来源1": "small"} and row.omitted == ["big"] and row.context == "〔来源1〕 第2页·章\ny"
    assert context.baseline_context(hits).count() == 0
    assert context.baseline_context(hits.where("rank = 2")).head().context == "〔第2页·章〕\ny"
    known = context.citations_known(F.lit("见〔来源1〕"), F.create_map(F.lit("来源1"), F.lit("a")))
    assert spark.range(1).select(known, context.citations_known(F.lit("〔来源9〕"), F.create_map(F.lit("来源1"), F.lit("a")))).head() == (True, False)


def test_neighbours_in_order(spark):
    rows = spark.createDataFrame([(k, i) for k, i in enumerate("zabc")], "pos int, id string")
    assert [r.id for r in neighbours(rows, rows.where("id = 'a'")).orderBy("pos").collect()] == ["z", "a", "b"]
    assert [r.id for r in neighbours(rows, rows.where("id = 'c'")).orderBy("pos").collect()] == ["b", "c"]


def test_variants(spark):
    got = {x.variant: x.text for x in one(spark, perturb.variants(F.col("q")), q="员工请事假2天，怎么办？")}
    assert got["punct_strip"] == "员工请事假2天怎么办" and got["spacey"] == "员工请事假2 天，怎么办？" and got["fullwidth_digit"] == "员工请事假２天，怎么办？"
    assert got["typo_drop"] == "员工事假2天，怎么办？" and got["truncated"] == "员工请事假2" and got["noise_prefix"] == "顺便再问个事，员工请事假2天，怎么办？，谢谢！" and len(got) == 10
    assert "typo_drop" not in {x.variant for x in one(spark, perturb.variants(F.col("q")), q="请假")}
    assert perturb.boundary_suite(spark, fusion.MODES).count() == 36


def test_checks(spark):
    answers = spark.createDataFrame([("a", "见〔第 21 页·第四章 考勤 > 第二节 休假 > 1.1~1.4〕和〔第99页·x〕"), ("b", "〔第3页·前言〕〔第 21 页〕〔第21页·第五章〕")], "qid string, answer string")
    chunks = spark.createDataFrame([([21, 22], "第四章 考勤 > 第二节 休假 > 1.1"), ([3], "")], "pages array<int>, path string")
    got = {(r.qid, r.page, r.claim[:3]): (r.page_ok, r.path_ok) for r in checks.citation_report(answers, chunks).collect()}
    assert got == {("a", 21, "第四章"): (True, True), ("a", 99, "x"): (False, False), ("b", 3, "前言"): (True, True), ("b", 21, ""): (True, True), ("b", 21, "第五章"): (True, False)}
    ask = lambda answer, expect, must=(), bad=(): one(spark, checks.expectation(F.lit(answer), F.lit(expect), F.array(*[F.array(*map(F.lit, g)) for g in must]).cast("array<array<string>>"), F.array(*map(F.lit, bad)).cast("array<string>"), F.lit(1)), x=1)
    assert ask("手册没有规定", "reject_premise") and not ask("好", "refuse") and not ask("无法说明密码", "refuse", bad=["密码"]) and ask("请联系HR", "escalate")
    assert ask("三天", "answer_with_citation", [["三天", "3天"]]) and not ask("三天", "answer_with_citation") and ask("三天", "cite_rule", [["三"]]) and ask("x", "unknown") is None
    quotes = spark.createDataFrame([("q", "c", "a b", "3天 5天")], "qid string, source_chunk string, quote string, answer string")
    assert tuple(checks.quote_checks(quotes, spark.createDataFrame([("c", "xa\nb 3 天")], "id string, text string")).head()) == ("q", True, ["5天"])


def test_experiment_columns(spark):
    rows = spark.createDataFrame([("v", 1.0, 10), ("v", 2.0, None), ("v", 3.0, 5), ("v", 4.0, 5)], "variant string, s double, t long")
    got = rows.groupBy("variant").agg(experiment.interpolated_median("s").alias("m"), experiment.nearest_rank("s").alias("p"), experiment.total_if_all_known("t").alias("a"), experiment.total_of_known("t").alias("k")).head()
    assert (got.m, got.p, got.a, got.k) == (2.5, 4.0, None, 20)
    runs = spark.createDataFrame([("one", "a", "complete", 4.0), ("one", "b", "complete", 6.0), ("two", "a", "timeout", 9.0), ("two", "b", "complete", 5.0)], "qid string, profile string, status string, seconds double")
    assert {r.profile: (r.n, r.p50) for r in experiment.paired_summary(runs, "qid", "profile", F.col("status") == "complete", "seconds").collect()} == {"a": (1, 4.0), "b": (1, 6.0)}


def test_attempts_and_usage(spark):
    replies = iter([generate.Reply("", "stop", 10, 5), generate.Reply("half", "length", 10, 5), generate.Reply(" whole ", "stop", 20, 10)])
    seen = []
    answer, status, usage = generate.attempt(lambda c, q, n: (seen.append(n), next(replies))[1], "", "q")
    assert (answer, status, seen) == ("whole", "complete", [2048, 4096, 8192]) and sum(u[2] + u[3] for u in usage) == 60
    cut = lambda c, q, n: generate.Reply("cut", "length")
    assert generate.attempt(cut, "", "q")[:2] == (None, "truncated") and generate.attempt(cut, "", "q", evidence=False)[:2] == ("cut", "truncated")
    assert len(generate.attempt(lambda c, q, n: generate.Reply(None, status_code=401), "", "q")[2]) == 1
    asked = spark.createDataFrame([("q", "c")], "question string, context string")
    row = generate.generate(asked, lambda: lambda c, q, n: generate.Reply(f"{q}!", "stop", 1, None)).withColumn("total", generate.total_tokens(F.col("usage"))).head()
    assert row.answer == "q!" and row.total is None
    assert one(spark, generate.profile_of(F.lit("fast")).thinking, x=1) == "disabled" and not generate.api_ready("k", " ")


def test_text_functions(spark):
    assert one(spark, T.split_lines(F.col("t")), t="a\nb\r\nc\n") == ["a", "b", "c"] and one(spark, T.split_lines(F.col("t")), t="") == []
    assert one(spark, T.strip(F.col("t")), t="　\t a b \n") == "a b" and one(spark, T.is_digits(F.col("t")), t="１２")
    assert one(spark, T.tolerant_json(F.col("t")).cast("string"), t='x {"a":1} y') == '{"a":1}' and one(spark, T.tolerant_json(F.col("t")).cast("string"), t="junk") == "{}"
    assert one(spark, T.csv_ints(F.col("t"), F.lit(7)), t="21,22") == [21, 22] and one(spark, T.csv_ints(F.col("t"), F.lit(7)), t="") == [7]
    assert one(spark, T.budget_ladder(), x=1) == [2048, 4096, 8192] and one(spark, T.bigrams(F.col("t")), t="x") == []
    table = F.array(F.array(F.lit("a|b"), F.lit(None)), F.array(F.lit("")), F.array(F.lit("1"), F.lit("2\n3"), F.lit("4"))).cast("array<array<string>>")
    assert one(spark, T.markdown_table(table), x=1) == "| a\\|b |  |  |\n| --- | --- | --- |\n| 1 | 2 3 | 4 |"
    assert one(spark, T.starts_like_toc(F.col("t")), t="目 　录") and one(spark, T.joined_path(F.lit("a"), F.lit(""), F.lit("b")), x=1) == "a > b"


def test_requests(spark):
    rows = spark.createDataFrame([("  q ", "fast"), ("　", "fast"), ("x" * 501, "fast"), ("q", "other"), (None, "fast")], "question string, profile string")
    assert [r.valid for r in valid_requests(rows).collect()] == [True, False, False, False, False]


def test_rows_are_appended_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, seq int").write.json(source)
    for turn in range(2):
        incremental.append_once(incremental.stream_rows(spark, source, "k string, seq int"), ("k", "seq"), target, str(tmp_path / f"cp{turn}")).awaitTermination()
    spark.createDataFrame([("a", 2), ("b", 1)], "k string, seq int").write.mode("append").json(source)
    incremental.append_once(incremental.stream_rows(spark, source, "k string, seq int"), ("k", "seq"), target, str(tmp_path / "cp1")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted(map(tuple, incremental.current(spark, target, ["k"], ["seq"]).collect())) == [("a", 2), ("b", 1)]


def test_answers_by_profile(spark):
    from rankweave.operators import ask

    corpus = spark.createDataFrame([("c1", 1, 7, "章", "病假 薪酬 全薪"), ("c2", 2, 8, "", "年假 规定 天数"), ("c3", 3, 9, "", "培训"), ("c4", 4, 9, "", "奖惩")], "id string, pos int, page int, path string, text string")
    lexical = lexical_ranker(build_index(corpus, han_bigrams=True))
    requests = spark.createDataFrame([("a", "病假薪酬", "quality"), ("c", "zzz", "quality"), ("d", " ", "quality"), ("e", "年假", "quality")], "qid string, question string, profile string")

    def client():
        return lambda context, question, n: generate.Reply("见〔来源1〕" if "病假" in question else "见〔来源9〕", "stop", 3, 4)

    got = {r.qid: r for r in ask.answer(requests, corpus, lexical=lexical, make_client=client, mode="bm25", profiles=("quality",)).collect()}
    assert {q: r.status for q, r in got.items()} == {"a": "complete", "c": "no_evidence", "d": "invalid", "e": "citation_failed"}
    assert got["a"].total_tokens == 7 and got["a"].sources[0].id == "c1" and got["a"].sources[0].in_context and got["e"].answer is None and got["e"].sources
    calls = spark.createDataFrame([("q", 1, n, "search") for n in range(5)] + [("q", 9, 0, "read")], "qid string, model_call int, seq int, tool string")
    assert sorted((r.tool, r.seq) for r in ask.admitted(calls).where("admitted").collect()) == [("search", 0), ("search", 1), ("search", 2)]
    fault = lambda tool, key, value: one(spark, ask.call_fault(F.lit(tool), F.create_map(F.lit(key), F.lit(value)), F.array(F.lit("c1"))), x=1)
    assert [fault("search", "query", "x"), fault("read", "chunk_id", "c1"), fault("read", "chunk_id", "c9"), fault("fly", "query", "x"), fault("search", "query", " "), fault("search", "chunk_id", "x")] == [None, None, "unknown_source", "unknown_tool", "bad_value", "bad_arguments"]


def test_red_team_screen_and_reports(spark):
    from rankweave.sources import reports

    cases = spark.createDataFrame([("r1", "high", "escalate", None, None), ("r2", "low", "refuse", None, ["密码"])], "rid string, risk string, expect string, must array<array<string>>, forbid_output array<string>")
    answers = spark.createDataFrame([("r1", "请咨询HR〔第2页·章〕〔第9页〕", None, 1.0), ("r2", "无法提供，密码是1", None, 3.0)], "rid string, answer string, error string, seconds double")
    rows = checks.red_team_screen(cases, answers, spark.createDataFrame([([2], "章")], "pages array<int>, path string"))
    assert {r.rid: (r.passed, r.n_citations, r.bad_pages, r.bad_paths) for r in rows.collect()} == {"r1": (True, 2, 1, 0), "r2": (False, 0, 0, 0)}
    summary = experiment.red_team_summary(rows)
    assert {r.risk: r.pass_rate for r in summary.collect()} == {"high": 1.0, "low": 0.0}
    text = reports.report("Red team", [("By risk", summary.select("risk", "n"))])
    assert text.startswith("# Red team\n\n## By risk\n\n| risk | n |\n| --- | --- |\n")
    lines = reports.smoke_lines(spark.createDataFrame([("a", True), ("b", False)], "qid string, passed boolean")).orderBy("line_no", "value").collect()
    assert [r.value for r in lines] == ["FAIL b", "PASS a", "1/2 passed"]


def test_summaries_by_group_make_no_array_or_map_of_a_group(spark):
    import random

    rnd = random.Random(3)
    data = [(g, None if rnd.random() < 0.1 else float(rnd.randrange(-20, 60))) for g, size in (("a", 301), ("b", 40), (None, 7), ("c", 1)) for _ in range(size)] + [("nothing known", None)]
    rows = spark.createDataFrame(data, "g string, s double").repartition(5)
    known = {g: sorted(s for h, s in data if h == g and s is not None) for g, _ in data}
    shown = experiment.latency_summary(rows, ["g"], "s")
    expected = {g: (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[len(v) // 2], v[-(-len(v) * 95 // 100) - 1]) for g, v in known.items() if v}
    assert {r.g: (r.n, r.median, r.upper_median, r.p95) for r in shown.collect()} == expected
    screened = rows.selectExpr("g risk", "true passed", "0 n_citations", "0 bad_pages", "0 bad_paths", "string(null) error", "s seconds")
    summary = experiment.red_team_summary(screened)
    assert {r.risk: r.median_seconds for r in summary.collect()} == {g: v[len(v) // 2] if v else None for g, v in known.items()}
    assert summary.columns[0] == "risk" and summary.columns[-1] == "median_seconds"
    for frame in (shown, summary):
        plan = frame._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "percentile" not in plan


def test_a_client_that_raises_is_an_attempt():
    class Refused(Exception):
        status_code = 401

    def client(fault, then):
        replies = iter([fault, then])

        def call(context, question, max_tokens):
            reply = next(replies)
            if isinstance(reply, Exception):
                raise reply
            return reply

        return call

    answer, status, usage = generate.attempt(client(TimeoutError("slow"), generate.Reply("fine", "stop", 1, 2)), "", "q")
    assert (answer, status, len(usage)) == ("fine", "complete", 2) and usage[0][5] == "TimeoutError: slow" and usage[0][2] is None
    assert generate.attempt(client(Refused("no key"), generate.Reply("fine")), "", "q")[1:] == ("generation_failed", [(1, 2048, None, None, None, "Refused: no key", 401)])


def test_lines_end_at_every_line_end(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x85f\u2028g\u2029\n"
    assert one(spark, T.split_lines(F.col("t")), t=text) == text.splitlines()


def test_similarity_at_the_threshold_is_not_rounded_up(spark):
    rows = spark.createDataFrame([(1, "abcdefghijklmnopq"), (2, "abcdefghijkxyzuvw")], "id int, text string")
    near = checks.similar_pairs(rows, 10 / 22).collect()
    assert [(r.left_id, r.right_id) for r in near] == [(1, 2)] and checks.similar_pairs(rows, 0.4545455).count() == 0

"""Vector cells against a full scan, tool loops against their limits, and corpus differences against sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import cells, compare, dense, generate, loop


def clustered(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 5
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * spread
    x[n // 2 :: 7] = x[0]  # a third of some cell is one vector
    return [(k, [float(v) for v in np.round(row, 3)]) for k, row in enumerate(x)] + [(n, None)]


@pytest.mark.parametrize(("spread", "block"), [(0.3, 4096), (20.0, 16)])
def test_cells_rank_like_a_full_scan(spark, spread, block):
    rows = clustered(1, 600, 8, spread)
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(q, rows[q * 31][1]) for q in range(15)] + [(99, None)], "qid long, embedding array<double>")
    index = cells.build_cells(vectors, block=block)
    for k in (1, 20):
        ranked, scored = cells.cell_rank(index, queries, k, 2)
        expected = dense.dense_rank(vectors, queries, k)
        assert sorted((r["qid"], r["rank"], r["id"]) for r in ranked.collect()) == sorted((r["qid"], r["rank"], r["id"]) for r in expected.collect())
        share = scored.agg(F.avg("scored")).head()[0] / 600
        assert share <= 1 and (spread > 1 or share < 0.5)  # cells that lie apart are left out


def test_cells_of_few_or_no_vectors(spark):
    schema = "id long, embedding array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    assert cells.cell_rank(cells.build_cells(spark.createDataFrame([], schema)), queries)[0].count() == 0
    few = cells.build_cells(spark.createDataFrame([(7, [0.5, 1.0]), (8, [0.7, 0.0])], schema))
    assert [(r["id"], r["score"]) for r in cells.cell_rank(few, queries)[0].orderBy("rank").collect()] == [(8, 0.7), (7, 0.5)]


CORPUS = [(f"c{k}", k, k, "path", f"text {k} " + "x" * (3000 if k == 4 else 10)) for k in range(8)]


def ran(spark, scripts):
    corpus = spark.createDataFrame(CORPUS, "id string, pos long, page int, path string, text string")

    def search(queries):
        return queries.select("qid", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.concat(F.lit("c"), F.col("text").cast("int") + r - 1).alias("id")) for r in (1, 2)])).alias("h")).select("qid", "h.rank", "h.id")

    def mover():
        def move(question, history):
            script = scripts[question]
            if isinstance(script, Exception):
                raise script
            return script[len(history)] if len(history) < len(script) else loop.Move(seconds=1.0)

        return move

    questions = spark.createDataFrame([(k, name) for k, name in enumerate(scripts)], "qid long, question string")
    return corpus, loop.tool_loop(questions, search, corpus, mover)


def test_every_end_of_a_loop(spark):
    find = lambda n: ("search", {"query": str(n)})
    read = lambda c: ("read", {"chunk_id": c})
    move = lambda *calls, **more: loop.Move(list(calls), seconds=more.pop("seconds", 1.0), **more)
    scripts = {
        "evidence": [move(find(0)), move(read("c1"))],
        "nothing": [],
        "budget inside one batch": [move(find(0), find(2), find(4), find(5))],
        "read budget": [move(find(3)), move(read("c3")), move(read("c4")), move(read("c3"))],
        "unknown tool": [move(find(0), ("fly", {"query": "x"}))],
        "read of what was not found": [move(read("c5"))],
        "two arguments": [move(("search", {"query": "1", "k": "2"}))],
        "late": [move(find(0), seconds=121.0)],
        "cut": [move(finish_reason="length")],
        "raises": ValueError("down"),
        "read before it is found in the batch": [move(read("c0"), find(0))],
        "found and read in one batch": [move(find(0), read("c0"))],
    }
    corpus, loops = ran(spark, scripts)
    found = {r["question"]: r for r in loops.collect()}
    ends = {q: (r["status"], r["stop_reason"], r["model_calls"], r["searchs"], r["reads"]) for q, r in found.items()}
    assert ends == {
        "evidence": ("complete", "evidence_ready", 3, 1, 1), "nothing": ("no_evidence", "no_sources", 1, 0, 0), "budget inside one batch": ("limited", "tool_budget", 1, 3, 0),
        "read budget": ("limited", "tool_budget", 4, 1, 2), "unknown tool": ("agent_failed", "invalid_tool_call", 1, 1, 0), "read of what was not found": ("agent_failed", "invalid_tool_call", 1, 0, 0),
        "two arguments": ("agent_failed", "invalid_tool_call", 1, 0, 0), "late": ("timeout", "orchestration_timeout", 1, 0, 0), "cut": ("limited", "model_output_limit", 1, 0, 0),
        "raises": ("agent_failed", "model_request_failed", 1, 0, 0), "read before it is found in the batch": ("agent_failed", "invalid_tool_call", 1, 0, 0), "found and read in one batch": ("complete", "evidence_ready", 2, 1, 1),
    }
    assert found["evidence"]["ids"] == ["c0", "c1", "c2"] and found["read budget"]["ids"] == ["c3", "c4", "c2", "c5"]
    assert found["budget inside one batch"]["ids"] == ["c0", "c1", "c2", "c3", "c4", "c5"] and len(found["evidence"]["history"]) == 2

    def client():
        return lambda packed, question, most: generate.Reply("〔来源9〕" if question == "evidence" else "〔来源1〕", "stop", 1, 1)

    answers = {r["qid"]: r for r in loop.synthesized(loops, corpus, client, budget=400).collect()}
    numbered = {q: k for k, q in enumerate(scripts)}
    assert len(answers) == len(scripts)
    assert answers[numbered["evidence"]]["status"] == "citation_failed" and answers[numbered["evidence"]]["answer"] is None
    limited = answers[numbered["read budget"]]
    assert limited["status"] == "complete" and set(limited["in_context"]) < set(limited["gathered"]) and "c4" not in limited["in_context"]
    assert answers[numbered["nothing"]]["status"] == "no_evidence" and answers[numbered["raises"]]["gathered"] == []


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_differences_of_corpora(spark, levels):
    schema = "id long, text string"
    frozen = [(k, f"t{k}") for k in range(200)] + [(500, None), (None, "n"), (7, "t7")]
    actual = [(k, f"t{k}" if k % 50 else "new") for k in range(3, 200)] + [(500, ""), (None, "n"), (900, "a")]
    found = compare.differences(spark.createDataFrame(frozen, schema), spark.createDataFrame(actual, schema), levels)
    expected = {0: "lost", 1: "lost", 2: "lost", 50: "changed", 100: "changed", 150: "changed", 500: "changed", 7: "changed", 900: "added"}
    assert {r["id"]: r["change"] for r in found.collect()} == expected
    same = spark.createDataFrame(frozen, schema)
    assert compare.differences(same, same.repartition(5), levels).count() == 0
    assert compare.differences(same.limit(0), same.limit(0), levels).count() == 0


def test_boxes_in_areas_of_any_size(spark):
    from rankweave.sources.documents import contained

    rng = np.random.default_rng(3)
    made = lambda n, size: [(int(p), k, float(x), float(y), float(x + w), float(y + h)) for k, (p, x, y, w, h) in enumerate(zip(rng.integers(0, 3, n), rng.uniform(-50, 500, n).round(1), rng.uniform(-50, 500, n).round(1), rng.uniform(0, size, n).round(1), rng.uniform(0, size, n).round(1)))]
    boxes, areas = made(300, 20) + [(1, 999, None, 1.0, 2.0, 3.0)], made(25, 300)
    columns = "page int, {} int, x0 double, top double, x1 double, bottom double"
    found = contained(spark.createDataFrame(boxes, columns.format("box")), spark.createDataFrame(areas, columns.format("area")), slack=2.0)
    expected = {(p, b, a) for p, b, x0, t, x1, m in boxes if x0 is not None for q, a, ax0, at, ax1, am in areas if p == q and x0 >= ax0 - 2 and t >= at - 2 and x1 <= ax1 + 2 and m <= am + 2}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected) > 20


def test_accepted_items_are_not_asked_again(spark, tmp_path):
    log = str(tmp_path / "asked")

    def asker():
        def ask(prompt, temperature):
            with open(log, "a") as out:
                out.write(f"{prompt} {temperature}\n")
            if prompt == "never":
                raise RuntimeError("down")
            return {"first": "first", "second": "second" if temperature > 0 else None}[prompt]

        return ask

    items = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never")], "qid long, prompt string").coalesce(1)
    found = generate.residual_rounds(items, asker, lambda prompt, reply: reply == prompt, (0.0, 0.5, 1.0))
    assert {r["qid"]: (r["status"], r["round"], r["reply"]) for r in found.collect()} == {1: ("accepted", 1, "first"), 2: ("accepted", 2, "second"), 3: ("exhausted", 3, None)}
    assert sorted(open(log).read().split("\n")[:-1]) == ["first 0.0", "never 0.0", "never 0.5", "never 1.0", "second 0.0", "second 0.5"]

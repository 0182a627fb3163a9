"""Reciprocal-rank fusion, query expansion, facets and evidence selection over tables of ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.functions.text import contains_any, ordered_distinct, strip

RRF_K, FINAL_K, MOST_QUERIES = 60, 8, 3
MODES, STRATEGIES = ("rrf", "dense", "bm25"), ("baseline", "expanded", "coverage", "guarded")


@dataclass(frozen=True)
class Rule:
    """Facets added to a query that has a term of every group; ``unless`` gives other facets when its term is there."""

    groups: tuple[tuple[str, ...], ...]
    facets: tuple[str, ...]
    prepend: bool = False
    unless: tuple[str, tuple[str, ...]] | None = None


#: Expansion rules in the order in which they are tried.
RULES: tuple[Rule, ...] = (
    Rule((("电脑", "设备", "财物", "财产"), ("坏", "损", "丢", "赔")), ("公司资产 公司财产 故意 过失 毁损 追偿", "经济赔偿 经济损失 扣发工资")),
    Rule((("工资", "薪水", "薪酬"), ("到账", "发", "结算", "何时", "几天")), ("发薪时间 发薪日 薪酬核算周期",)),
    Rule((("工资", "薪水", "薪酬"), ("到账", "发", "结算", "何时", "几天"), ("离职", "辞职", "交接")), ("离职工资 交接 结算",)),
    Rule((("假",), ("工资", "餐补", "扣", "薪")), ("休假 全薪假 带薪扣减福利假 无薪假", "餐费补贴 实际出勤 休假 扣减"), unless=("事假", ("事假 无薪假 薪酬 福利", "餐费补贴 实际出勤 休假 扣减"))),
    Rule((("病假",),), ("病假 薪酬 全薪 半薪 福利病假", "入职 转正 福利病假天数 折算"), prepend=True),
    Rule((("迟到", "早退"),), ("迟到 早退 连续 纪律处分 记过", "累进式处罚 一般违纪 严重违纪")),
    Rule((("转岗", "调动", "换部门", "换到"),), ("员工发起 公司发起 调动 离任审计", "内部人才流动 原岗位 书面同意")),
    Rule((("年假",),), ("法定年假 福利年假 社会工龄 年度上限", "福利年假 转正日 折算")),
)
#: A scope that replaces all facets by one.
SCOPES: tuple[Rule, ...] = (Rule((("试用期",), ("迟到", "早退")), ("试用期 迟到 早退 不符合录用条件",)),)


def _holds(query: Column, rule: Rule) -> Column:
    hit = F.lit(True)
    for group in rule.groups:
        hit = hit & contains_any(query, group)
    return hit


def _literals(items: Sequence[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def expanded_queries(query: Column, rules: Sequence[Rule] = RULES, most: int = MOST_QUERIES) -> Column:
    """The query and the facets of the rules it meets, distinct, at most ``most``; none for a blank query."""
    query, facets = strip(query), F.array().cast("array<string>")
    for rule in rules:
        own = _literals(rule.facets)
        if rule.unless:
            own = F.when(F.contains(query, F.lit(rule.unless[0])), _literals(rule.unless[1])).otherwise(own)
        facets = F.when(_holds(query, rule), F.concat(own, facets) if rule.prepend else F.concat(facets, own)).otherwise(facets)
    return F.when(F.coalesce(query, F.lit("")) == "", F.array().cast("array<string>")).otherwise(ordered_distinct(F.concat(F.array(query), facets), most))


def scoped_queries(query: Column, rules: Sequence[Rule] = RULES, scopes: Sequence[Rule] = SCOPES) -> Column:
    """As :func:`expanded_queries`, but a query of a scope keeps to that scope's facet."""
    found = expanded_queries(query, rules)
    for scope in scopes:
        found = F.when(_holds(strip(query), scope), F.concat(F.array(strip(query)), _literals(scope.facets))).otherwise(found)
    return found


def query_list(query: Column, strategy: str, rules: Sequence[Rule] = RULES) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy == "baseline":
        return F.when(F.coalesce(strip(query), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(strip(query)))
    return scoped_queries(query, rules) if strategy == "guarded" else expanded_queries(query, rules)


def fuse(ranks: DataFrame, by: Sequence[str] = ("qid",), constant: int = RRF_K) -> DataFrame:
    """``ranks`` (*by, channel_no, id, rank) -> (*by, id, rrf, fused_rank).

    Scores add 1 / (constant + rank) over the channels; ties keep the order in which ids first come: by channel, then rank.
    """
    first = F.min(F.struct("channel_no", "rank"))
    scores = ranks.groupBy(*by, "id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 12).alias("rrf"), first.alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf"), "first")
    return scores.withColumn("fused_rank", F.row_number().over(order)).drop("first")


def facet_orders(ranks: DataFrame, guarded: bool = False, lexical: str = "bm25") -> DataFrame:
    """``ranks`` (qid, query_no, channel, channel_no, id, rank) -> (qid, query_no, id, facet_rank), each query fused alone.

    ``guarded``: the lexical first of every added query goes to the front of its order.
    """
    fused = fuse(ranks, ("qid", "query_no"))
    if not guarded:
        return fused.withColumnRenamed("fused_rank", "facet_rank").drop("rrf")
    anchors = ranks.where((F.col("channel") == lexical) & (F.col("rank") == 1) & (F.col("query_no") > 0)).select("qid", "query_no", "id", F.lit(0).alias("anchor"))
    order = Window.partitionBy("qid", "query_no").orderBy(F.coalesce("anchor", F.lit(1)), "fused_rank")
    return fused.join(anchors, ["qid", "query_no", "id"], "left").select("qid", "query_no", "id", F.row_number().over(order).alias("facet_rank"))


def _ordered(df: DataFrame, by: Sequence[str], rank: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, "id"))), lambda x: x["id"]).alias(name))


def selected(fused: Column, facets: Column, k: int, first: int = 3, each: int = 2) -> Column:
    """Up to ``first`` ids of the first facet, ``each`` new ones of every other, then the fused order, ``k`` in all."""
    if k <= 0:
        return F.slice(fused, 1, 0)
    own = lambda facet: F.array_intersect(facet, fused)
    start = F.slice(own(F.get(facets, 0)), 1, min(first, k))
    taken = F.aggregate(F.slice(facets, F.lit(2), F.greatest(F.size(facets) - 1, F.lit(0))), start, lambda s, f: F.concat(s, F.slice(F.array_except(own(f), s), 1, each)))
    whole = F.slice(F.concat(taken, F.array_except(fused, taken)), 1, k)
    return F.when(F.size(facets) <= 1, F.slice(fused, 1, k)).otherwise(whole)


def select_evidence(fused: DataFrame, facets: DataFrame, k: int = FINAL_K) -> DataFrame:
    """(qid, id, pick) from ``fused`` (qid, id, fused_rank) and ``facets`` (qid, query_no, id, facet_rank).

    A query has at most a few dozen ranked ids, so its lists fit a row.
    """
    orders = _ordered(facets, ("qid", "query_no"), "facet_rank", "ids").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_no", "ids"))), lambda x: x["ids"]).alias("facets"))
    lists = _ordered(fused, ("qid",), "fused_rank", "fused").join(orders, "qid", "left")
    picked = lists.select("qid", F.posexplode(selected(F.col("fused"), F.coalesce("facets", F.array().cast("array<array<string>>").cast(dict(orders.dtypes)["facets"])), k)).alias("at", "id"))
    return picked.select("qid", "id", (F.col("at") + 1).alias("pick"))

"""Reply trees as conversations: the best root-to-leaf path of each tree, formatted with a loss mask, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.session import checkpointed, stored
from rankweave.sources.tables import table

#: The template: a turn is START role MIDDLE text END; fixed values of this format.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Characters with which control strings start, here and in other common templates.
OPENERS = "<["


def escaped(text: Column) -> Column:
    """The text with a backslash after every opener and doubled backslashes: no control string can stand in it."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for opener in OPENERS:
        text = F.replace(text, F.lit(opener), F.lit(opener + "\\"))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`."""
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def chosen_paths(messages: DataFrame) -> DataFrame:
    """(tree, node, depth) of the best root-to-leaf path of each tree.

    ``messages`` has tree, node (unique in the tree), parent (null or unknown: a root) and score. Self-joins that double
    the distance each time give every node its root, its depth and the sum of scores from the root on; of the leaves the
    one with the highest sum wins, then the deeper, then the one with the smaller node. The path from it to its root is
    marked by the same jumps backwards. Messages on a cycle reach no root and stand on no path. Messages of a null tree
    are one tree.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("decimal(38,6)").alias("score"))
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))
    # each node by one number from here on; up: the ancestor 2^k replies above; steps, total: of the nodes below it
    parents = nodes.select(F.col("tree").alias("of"), F.col("node").alias("parent"), F.col("id").alias("up"))
    reach = nodes.alias("n").join(parents.alias("p"), F.col("tree").eqNullSafe(F.col("of")) & (F.col("n.parent") == F.col("p.parent")), "left")
    reach = checkpointed(reach.select("id", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")))
    jumps, still, before = [], reach.where("up is not null").count(), -1
    first = reach
    while still and still != before:  # each round some node arrives, if any can: what does not lies on a cycle or hangs on one
        active, resting = reach.where("up is not null"), reach.where("up is null")
        jumps.append(active.select("id", "up"))
        above = reach.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        total = (F.col("total") + F.col("total2")).cast("decimal(38,6)").alias("total")
        reach = checkpointed(active.join(above, "up").select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), total).unionByName(resting))
        before, still = still, reach.where("up is not null").count()
    rooted = reach.where("up is null").select("id", "steps", "total")
    leaves = nodes.select("id", "tree", "node").join(first.select(F.col("up").alias("id")), "id", "left_anti").join(rooted, "id")
    best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("a"), (-F.col("steps")).alias("b"), "node", "id")).alias("best"))
    path = checkpointed(best.select("best.id"))
    for jump in reversed(jumps):  # from the longest on: every ancestor is met once
        path = checkpointed(path.unionByName(path.join(jump, "id").select(F.col("up").alias("id"))))
    return path.join(rooted, "id").join(nodes, "id").select("tree", "node", F.col("steps").alias("depth"))


def format_paths(messages: DataFrame) -> DataFrame:
    """One conversation for each tree of ``messages`` (tree, node, parent, score, role, text): tree, n_turns, formatted, loss.

    ``formatted`` is the chosen path in reply order, turn by turn; null roles and texts are empty. ``loss`` lists start and
    length, in characters of ``formatted``, of the (escaped) texts of role ``assistant``, in order. Messages that share
    tree and node all stand at its place, by role and text; the least of parent, score, role and text (null first) says where that is. Trees without a root give no row; messages of a null tree are one
    tree; an empty table gives none.
    """
    least = F.min(F.struct("parent", "score", F.col("role").alias("r"), F.col("text").alias("t"))).alias("least")
    places = messages.groupBy("tree", "node").agg(least).select("tree", "node", "least.parent", "least.score")
    paths = chosen_paths(places).select(F.struct("tree").alias("tree"), "node", "depth")
    messages = messages.withColumn("tree", F.struct("tree"))  # joins to its like when it holds null
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), escaped(F.col("role")).alias("shown"), escaped(F.col("text")).alias("text"))
    turns = messages.join(paths, ["tree", "node"]).groupBy("tree").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = lambda t: F.concat(F.lit(START), t["shown"], F.lit(MIDDLE), t["text"], F.lit(END))
    fixed = len(START) + len(MIDDLE)
    at = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["shown"]) + F.length(t["text"]) + fixed + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(s["loss"], F.array(F.struct((s["at"] + F.length(t["shown"]) + fixed).alias("start"), F.length(t["text"]).cast("long").alias("length"))))).otherwise(s["loss"]).alias("loss"),
        ),
        lambda s: s["loss"],
    )
    return turns.select("tree.tree", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", whole), "").alias("formatted"), at.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns (role, text), read from ``formatted`` alone, and loss_text, what stands under the mask, both unescaped."""
    # END ends every turn, so the last part is empty
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    side = lambda p, n: unescaped(F.split(F.substring(p, F.lit(len(START) + 1), F.length(p)), r"<\|im_sep\|>", 2)[n])
    turns = F.transform(parts, lambda p: F.struct(side(p, 0).alias("role"), side(p, 1).alias("text")))
    under = F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return conversations.withColumns({"turns": turns, "loss_text": F.array_join(under, "")})


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ok = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    rows = rows.unionByName(extra)
    # rows that share a turn follow one another by role and text
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.withColumn("node", node).select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
    numbered = stored(numbered, "messages")
    found = read_back(format_paths(numbered))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return found.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same from the table alone: every conversation is a chain, so its best path is all of it.
OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + length(text) - length(replace(text, '<', ''))
    + length(text) - length(replace(text, '[', '')) AS shown,
    length(role) + length(role) - length(replace(role, chr(92), '')) + length(role) - length(replace(role, '<', ''))
    + length(role) - length(replace(role, '[', '')) AS shown_role
  FROM rows
), folded AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum(shown + shown_role + 33) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM folded
"""

"""Reply trees to chat transcripts, with DataFrame operations only.

Messages name their parent. Self-joins over jump pointers double the distance per round: after log2 of
the depth, every message knows its depth and the summed score of its path from the root. Leaves are
ranked per conversation; the messages of a chosen branch are then collected by walking the pointer tables
back, and every branch is formatted as one transcript with its loss spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage

# Fixed template: a turn is <|im_start|>role, line feed, text, <|im_end|>, line feed. Inside texts every
# backslash is doubled and the opening <| gets one, so no text can hold a control string; roles are
# URL-encoded.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: ``conv, branch, depth, role, text`` for the ``branches`` best
    leaves of each conversation (``branch`` from 1).

    ``messages``: ``conv`` string, ``msg`` long (unique in a conversation), ``parent`` long, ``role``,
    ``text``, ``score`` long (null: 0). A branch's rank is its summed score, ties to the smaller leaf. A
    null or unknown parent makes a root. Messages on a cycle have no root and are left out.
    """
    ids = messages.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("known"))
    jump = cut_lineage(messages.join(ids, ["conv", "parent"], "left").select(
        "conv", F.col("msg").alias("node"), F.when(F.col("known"), F.col("parent")).alias("jump"),
        F.coalesce("score", F.lit(0)).cast("long").alias("total"), F.lit(1).cast("long").alias("steps")), "jump")
    base, rounds, done = jump, [], jump.filter(F.col("jump").isNull())
    n = None
    while True:
        going = jump.filter(F.col("jump").isNotNull())
        if not going.limit(1).count():
            break
        n = base.count() if n is None else n
        if 1 << len(rounds) > n:
            break  # longer than all messages: a cycle
        rounds.append(going.select("conv", "node", "jump"))
        # what is ahead: messages whose way to the root is known, and those still under way
        ahead = done.unionByName(going).select("conv", F.col("node").alias("jump"), F.col("jump").alias("far"),
                                               F.col("total").alias("t"), F.col("steps").alias("s"))
        jump = cut_lineage(going.join(ahead, ["conv", "jump"]).select(
            "conv", "node", F.col("far").alias("jump"), (F.col("total") + F.col("t")).alias("total"),
            (F.col("steps") + F.col("s")).alias("steps")), "jump")
        done = done.unionByName(jump.filter(F.col("jump").isNull()))
    parents = base.filter(F.col("jump").isNotNull()).select("conv", F.col("jump").alias("node")).distinct()
    leaves = done.join(parents, ["conv", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), "node"))
    marked = cut_lineage(leaves.withColumn("branch", rank).filter(F.col("branch") <= branches)
                         .select("conv", "branch", "node", "steps"), "branches")
    for i, far in reversed(list(enumerate(rounds))):  # each distance from the leaf is one sum of powers of two
        more = marked.join(far, ["conv", "node"]).select("conv", "branch", F.col("jump").alias("node"),
                                                         (F.col("steps") - (1 << i)).alias("steps"))
        marked = cut_lineage(marked.unionByName(more), "branches")
    return marked.join(messages.select("conv", F.col("msg").alias("node"), "role", "text"), ["conv", "node"]).select(
        "conv", "branch", (F.col("steps") - 1).alias("depth"), "role", "text")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it (by turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    plain = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("t"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    numbered = plain.withColumn("msg", F.row_number().over(order).cast("long"))
    return numbered.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), "msg",
                           F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text",
                           F.lit(0).cast("long").alias("score"))


def formatted(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One transcript per branch: ``conv, branch, formatted`` and ``loss`` (spans of the learned role's
    texts: ``start`` from 0 and ``size`` in characters). A transcript is one string, so a conversation must
    fit into one; its turns meet in one row for that reason only."""
    order = Window.partitionBy("conv", "branch").orderBy("depth")
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    made = turns.select("conv", "branch", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    whole = F.length("head") + F.length("body") + len(CLOSE) + 1
    made = made.withColumn("begin", F.sum(whole).over(order) - whole + F.length("head"))
    grouped = made.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(F.struct(
        "depth", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("piece"), F.col("begin").alias("start"),
        F.length("body").alias("size"), (F.col("role") == learn_role).alias("learn")))).alias("turns"))
    return grouped.select(
        "conv", "branch", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["size"])).alias("loss"))


def read_back(transcripts: DataFrame) -> DataFrame:
    """``conv, branch, formatted, turns array<struct<role,text>>, learned`` (text under the loss mask)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    body = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = F.transform(body, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    turns = F.transform(cut, lambda x: F.struct(
        F.url_decode(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return transcripts.select("conv", "branch", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))


def chat_transcripts(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Transcripts of linear conversations. Null roles and texts are empty; null turns come first; rows of
    a null conversation id form one conversation (``conv`` = 'null'); repeated rows and tied turns stay, in
    order of role and text; an empty table gives an empty result; other columns are not read."""
    return formatted(paths(cut_lineage(chains(rows, conv, turn, role, text), "messages")))

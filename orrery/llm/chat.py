"""Chat formatting from reply trees, with DataFrame functions only (operator 9).

Messages form trees by (conv_id, msg_id, parent_id). Root-to-leaf paths are found by iterative
self-joins with doubling: in round k every message knows its ancestor 2^k steps up, and the sum of
scores and the number of messages on the way, so a path of n messages takes log2(n) joins and the
rows never multiply. Leaves are ranked by their branch's score; the best `branches` of each
conversation are kept, and the messages on a kept leaf's path are enumerated by going back through
the same jumps. Each path is formatted as one conversation.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Control strings inside a text or role
get a backslash after their first character, and one more where they have some already; the reader
takes one away. So the formatted text has control strings only where the template put them.

Null role or text: empty. Equal turns stay; several rows of one (conv_id, turn) are ordered by
role and text. Of messages with one (conv_id, msg_id) the least by (parent_id, role, text, score) counts, nulls first. Rows without a
conv_id or msg_id belong to no conversation and are left out. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.store import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The tails of control strings, after their first character.
_CONTROL = r"(\|im_start\||\|im_end\||\|endoftext\||\|system\||\|user\||\|assistant\||/?s>|<SYS>>|</SYS>>|/?INST\])"
_ESCAPE = r"([<\[])(\\*)" + _CONTROL
_UNESCAPE = r"([<\[])\\(\\*)" + _CONTROL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def reply_tree(turns: DataFrame) -> DataFrame:
    """Messages of plain turns: (conv_id, msg_id, parent_id, role, text, score), a chain for each conversation."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    return ids.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def unique_messages(messages: DataFrame) -> DataFrame:
    """One row of each (conv_id, msg_id); see the module for which."""
    order = W.partitionBy("conv_id", "msg_id").orderBy("parent_id", "role", "text", "score")
    return messages.where("conv_id is not null and msg_id is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def chosen_paths(messages: DataFrame, branches: int = 1, max_rounds: int = 40) -> DataFrame:
    """(conv_id, path, place, msg_id): the messages of the best root-to-leaf paths, place from 1.

    Paths are ranked by the sum of their messages' scores, then by length, then by leaf id. A
    message whose parent is missing is a root. Raises on cycles.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "chat")
    slim = unique_messages(messages).select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = slim.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    first = slim.join(ids.distinct(), ["conv_id", "parent_id"], "left").select("conv_id", "msg_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    state = scratch.write(first, "jump-0")
    done, active = state.where("up is null"), state.where("up is not null")
    jumps = [active]
    for k in range(1, max_rounds + 1):
        if not active.limit(1).count():
            break
        # Only messages still on their way join again; the rows made in all rounds stay near the messages' number.
        known = done.unionByName(active).select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        both = active.join(known, ["conv_id", "up"])
        state = scratch.write(both.select("conv_id", "msg_id", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps")), f"jump-{k}")
        done, active = done.unionByName(state.where("up is null")), state.where("up is not null")
        jumps.append(active)
    else:
        raise ValueError("the reply tree has a cycle")
    total = done
    parents = jumps[0].select("conv_id", F.col("up").alias("msg_id")).distinct()
    leaves = total.join(parents, ["conv_id", "msg_id"], "left_anti")
    rank = W.partitionBy("conv_id").orderBy(F.desc("sum"), F.desc("steps"), "msg_id")
    best = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= branches)
    on = best.select("conv_id", "path", "msg_id", F.col("steps").alias("place"))
    for k in range(len(jumps) - 2, -1, -1):  # every distance below 2^k+1 is a sum of powers of two
        up = jumps[k].select("conv_id", "msg_id", "up")
        more = on.join(up, ["conv_id", "msg_id"]).select("conv_id", "path", F.col("up").alias("msg_id"), (F.col("place") - 2**k).alias("place"))
        on = scratch.write(on.unionByName(more), f"on-{k}")
    return on


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, path, formatted, loss): one string for each chosen path, and its loss mask.

    loss: start (1-based) and length, in characters of `formatted`, of the assistant texts.
    """
    body = unique_messages(messages).select("conv_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), escape(name), F.lit("\n"))
    said = escape(F.col("text"))
    turn = F.struct("place", head.alias("head"), said.alias("said"), (F.col("role") == "assistant").alias("loss"))
    joined = chosen_paths(messages, branches).join(body, ["conv_id", "msg_id"])
    rows = joined.groupBy("conv_id", "path").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        size = F.length(t["said"]).cast("long")
        own = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + len(CLOSE)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(CLOSE))), "")
    return rows.select("conv_id", "path", text.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: the inverse of the template."""
    piece = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p.startswith(OPEN))

    def one(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        cut = F.instr(rest, F.lit("\n"))
        role = unescape(F.substring(rest, F.lit(1), cut - 1))
        plain = F.replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), F.lit("\\\\"), F.lit("\\"))
        return F.struct(plain.alias("role"), unescape(F.substring(rest, cut + 1, F.length(rest))).alias("text"))

    return F.transform(piece, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")

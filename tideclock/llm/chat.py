"""Chat formatting of reply trees.

Messages point at their parents. Iterated self-joins double the distance that
each message can see up its tree, which gives every root-to-leaf path its
length and score in a logarithmic number of steps; the best paths of a tree
are written as conversations.

Template. Control strings are ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``[ROLE]`` and ``[/ROLE]``. A user turn is ``[INST] text [/INST]``, an
assistant turn ``text</s>``, any other ``[ROLE]role[/ROLE]text</s>``, and a
conversation starts with ``<s>``. Inside texts and roles a backslash follows
every backslash, ``[`` and ``<``, so that no control string can appear there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tideclock.llm import scratch

_OPEN = re.compile(r"([\\\[<])")
_SHUT = re.compile(r"([\\\[<])\\")


def escape(text: str) -> str:
    return _OPEN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: spans of the assistant texts in code points."""
    out, mask, at = ["<s>"], [], 3
    for role, text in turns:
        body = escape(text or "")
        if role == "user":
            part = f"[INST] {body} [/INST]"
        elif role == "assistant":
            part = f"{body}</s>"
            mask.append((at, at + len(body)))
        else:
            part = f"[ROLE]{escape(role or '')}[/ROLE]{body}</s>"
        out.append(part)
        at += len(part)
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 3
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index(" [/INST]", at + 6)
            turns.append(("user", unescape(formatted[at + 7 : end])))
            at = end + 8
            continue
        role = "assistant"
        if formatted.startswith("[ROLE]", at):
            end = formatted.index("[/ROLE]", at)
            role, at = unescape(formatted[at + 6 : end]), end + 7
        end = formatted.index("</s>", at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + 4
    return turns


def best_leaves(messages: DataFrame, branches: int) -> tuple[DataFrame, list[DataFrame]]:
    """The ``branches`` best leaves of each tree, and the jump tables up the trees.

    ``messages`` has tree, node, parent (null or unknown: a root) and score. A
    path's score is the sum over its messages; ties go to the smaller leaf.
    Jump table i leads each message 2**i steps up. Messages on a cycle have no
    root and belong to no path.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = nodes.select("tree", "node", "score", F.col("parent").alias("up"))
    up = up.join(known.withColumnRenamed("parent", "up").withColumn("there", F.lit(True)).hint("merge"), ["tree", "up"], "left")
    up = up.select("tree", "node", F.when(F.col("there"), F.col("up")).alias("up"), "score")
    up = scratch.materialize(up, "jump")
    total, jumps, finished = up.count(), [], []
    while True:
        # Messages that see their root are done; the others look twice as far, through whatever they point at.
        active = up.filter(F.col("up").isNotNull())
        finished.append(up.filter(F.col("up").isNull()))
        if active.isEmpty() or 1 << len(jumps) > total:
            break
        jumps.append(active.select("tree", "node", "up"))
        seen = reduce(DataFrame.unionByName, finished, active)
        above = seen.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"))
        up = active.join(above.hint("merge"), ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        up = scratch.materialize(up, "jump")
    inner = nodes.filter(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    leaves = reduce(DataFrame.unionByName, finished).join(inner.hint("merge"), ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), "node"))
    return leaves.withColumn("branch", rank).filter(F.col("branch") <= branches), jumps


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, steps, node): the messages of the chosen paths, ``steps`` above the leaf."""
    leaves, jumps = best_leaves(messages, branches)
    on = leaves.select("tree", "branch", F.lit(0).alias("steps"), "node")
    for i in reversed(range(len(jumps))):
        # Every message stays and brings the one 2**i above it along; the plan names ``on`` once a step.
        met = on.join(jumps[i].hint("merge"), ["tree", "node"], "left")
        both = F.array_compact(F.array(F.struct("steps", "node"), F.when(F.col("up").isNotNull(), F.struct((F.col("steps") + (1 << i)).alias("steps"), F.col("up").alias("node")))))
        on = met.select("tree", "branch", F.explode(both).alias("s")).select("tree", "branch", "s.steps", "s.node")
    return on


_TURNS = "array<struct<role:string,text:string>>"
FORMATTED = "formatted string, loss array<struct<start:bigint,stop:bigint>>"


def _format(turns: pd.Series) -> pd.DataFrame:
    out = [format_turns([(t["role"], t["text"]) for t in (x if x is not None else [])]) for x in turns]
    return pd.DataFrame({"formatted": [f for f, _ in out], "loss": [[{"start": a, "stop": b} for a, b in m] for _, m in out]})


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, formatted, loss): each chosen path as one conversation.

    ``messages``: tree, node, parent, role, text, score; (tree, node) is its
    key. A null text is empty; a null role is an empty one and a null score
    zero. An empty table gives an empty result; other columns are not read.
    """
    scratch.small_batches(messages.sparkSession)
    said = messages.select("tree", "node", "role", "text")
    on = paths(messages, branches).join(said.hint("merge"), ["tree", "node"])
    gathered = on.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), F.struct("role", "text").alias("turn")))).alias("turns"))
    made = gathered.select("tree", "branch", F.pandas_udf(_format, FORMATTED)(F.transform("turns", lambda t: t["turn"]).cast(_TURNS)).alias("f"))
    return made.select("tree", "branch", "f.formatted", "f.loss")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn answers the one before.

    Rows of one conversation with equal turns are put in order of role and text,
    nulls first; null turns come first, and a null conv_id is a conversation of
    its own. :func:`conv_id` tells a tree's conv_id. Repeated rows are turns
    each; an empty table gives no messages; other columns are not read.
    """
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    named = conversations.select(tree.alias("tree"), "turn", "role", "text")
    placed = named.withColumn("node", F.row_number().over(order).cast("long"))
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conv_id(tree: Column) -> Column:
    """The conv_id, as a string, of a tree that :func:`as_tree` has named."""
    return F.when(tree != "null", F.substr(tree, F.lit(2)))


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse_turns(formatted)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            learnt = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in loss)
            out.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """Read conversations back from their formatted texts and loss masks and digest them."""
    return formatted.select("tree", "formatted", "loss").mapInArrow(_digest, f"tree string, {DIGEST}")

"""Chat formatting: reply trees cut into their best branches, each written as one conversation.

Ids travel through the joins, texts do not: paths are found on (tree, node, parent)
alone, and the texts join the chosen paths once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import cut


def _meets(a: str, b: str) -> bool:
    """Whether a shorter end of ``a`` is a beginning of ``b``."""
    return any(b.startswith(a[i:]) for i in range(1, len(a)))


@dataclass(frozen=True)
class Template:
    """How turns are marked. A turn is ``open`` role ``middle`` text ``close``.

    ``foreign`` are control strings of other templates, which must not stand in a
    text either. No control string may hold the escape character or end as it begins,
    and no mark may end as another one begins: so none can arise where texts and
    marks meet.
    """

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    escape: str = "\\"

    def __post_init__(self) -> None:
        marks = (self.open, self.middle, self.close)
        for a in self.controls:
            if len(a) < 2 or self.escape in a or _meets(a, a):
                raise ValueError(f"{a!r} cannot be escaped")
            if a in marks and any(_meets(a, b) for b in marks):
                raise ValueError(f"{a!r} ends as another mark begins")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.foreign)

    def escaped(self, text: Column) -> Column:
        """The escape character doubled, and one put behind the first character of each control string."""
        one = self.escape
        out = F.replace(text, F.lit(one), F.lit(one + one))
        for mark in self.controls:
            out = F.replace(out, F.lit(mark), F.lit(mark[0] + one + mark[1:]))
        return out

    def unescape(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn, read from a formatted conversation."""
        found = []
        for turn in formatted.split(self.close)[:-1]:
            role, _, text = turn.removeprefix(self.open).partition(self.middle)
            found.append((self.unescape(role), self.unescape(text)))
        return found

    def masked(self, formatted: str, spans: Sequence) -> str:
        """The text under the loss mask, unescaped."""
        return "".join(self.unescape(formatted[s["begin"] : s["end"]]) for s in spans)


def branch_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, step, node): the messages of each chosen root-to-leaf path.

    ``messages`` has ``tree``, ``node`` (unique, not NULL), ``parent`` (NULL for a root)
    and ``score`` (NULL: 0). Each round of self-joins doubles the reach of every
    node's jump towards its root and adds up the scores on the way, until the root is
    reached: a path takes rounds in the logarithm of its length, and each round joins
    only the nodes that have not arrived. Leaves are ranked in their tree by the sum of
    scores of their path, then by length, both highest first, then by id; the
    ``branches`` best of each tree are chosen. The jumps then take the chosen paths apart
    again, each piece once into halves, down to single messages. A parent that is missing
    in the tree makes its replies roots. Messages on a cycle of replies have no root and
    are in no path.
    """
    slim = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    known = slim.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    level = cut(
        slim.join(
            known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")), "left"
        ).select("tree", "node", F.col("_node").alias("jump"), "score", F.lit(1).cast("bigint").alias("size")),
        "chat-jumps",
    )
    first, total = level, level.count()
    ended, levels = level.filter("jump IS NULL"), []
    while True:
        level = level.filter("jump IS NOT NULL")
        # What jumps farther than any path is long runs in a circle.
        if 1 << len(levels) > total or level.isEmpty():
            break
        levels.append(level)
        far = level.unionByName(ended).select(
            F.col("tree").alias("_tree"),
            F.col("node").alias("_node"),
            F.col("jump").alias("_jump"),
            F.col("score").alias("_score"),
            F.col("size").alias("_size"),
        )
        met = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("jump") == F.col("_node"))
        level = cut(
            level.join(far, met).select(
                "tree",
                "node",
                F.col("_jump").alias("jump"),
                (F.col("score") + F.col("_score")).alias("score"),
                (F.col("size") + F.col("_size")).alias("size"),
            ),
            "chat-jumps",
        )
        ended = ended.unionByName(level.filter("jump IS NULL"))
    inner = first.select(F.col("tree").alias("_tree"), F.col("jump").alias("_node")).distinct()
    leaves = ended.join(
        inner, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")), "left_anti"
    )
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("size"), "node")
    chosen = (
        leaves.withColumn("branch", F.row_number().over(order))
        .filter(F.col("branch") <= branches)
        .select("tree", F.col("node").alias("leaf"), "branch", F.col("size").alias("step"), "node", "size")
    )
    pieces = [cut(chosen, "chat-pieces")]
    for k in range(len(levels) - 1, -1, -1):
        reach = 1 << k
        longer = (F.col("size") > reach) & (F.col("size") <= 2 * reach)
        jumps = levels[k].select(
            F.col("tree").alias("_tree"), F.col("node").alias("_from"), F.col("jump").alias("_to")
        )
        near = F.struct("step", "node", F.lit(reach).cast("bigint").alias("size"))
        rest = F.struct(
            (F.col("step") - reach).alias("step"),
            F.col("_to").alias("node"),
            (F.col("size") - reach).alias("size"),
        )
        halves = _union([p.filter(longer) for p in pieces]).join(
            jumps, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_from"))
        )
        pieces.append(cut(halves.select("tree", "leaf", "branch", F.inline(F.array(near, rest))), "chat-pieces"))
    return _union([p.filter("size = 1") for p in pieces]).select("tree", "leaf", "branch", "step", "node")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def format_paths(paths: DataFrame, messages: DataFrame, template: Template | None = None) -> DataFrame:
    """(tree, leaf, branch, n_turns, formatted, loss): one row for each path.

    ``loss`` lists the ranges of ``formatted`` (code points from 0, end excluded) that
    hold the escaped texts of assistant turns. A NULL role or text counts as empty.
    """
    template = template or Template()
    texts = messages.select(
        F.col("tree").alias("_tree"),
        F.col("node").alias("_node"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = paths.join(
        texts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node"))
    ).select(
        "tree",
        "leaf",
        "branch",
        F.struct(
            "step",
            F.concat(F.lit(template.open), template.escaped(F.col("role")), F.lit(template.middle)).alias("head"),
            template.escaped(F.col("text")).alias("body"),
            (F.col("role") == "assistant").alias("learn"),
        ).alias("turn"),
    )
    whole = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"),
    )
    size = len(template.close)

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.char_length(turn["head"])
        end = begin + F.char_length(turn["body"])
        span = F.struct(begin.alias("begin"), end.alias("end"))
        spans = F.when(turn["learn"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((end + size).alias("at"), spans.alias("spans"))

    text = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.close)))
    return whole.select(
        "tree",
        "leaf",
        "branch",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.concat_ws("", text).alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss"),
    )


def format_trees(messages: DataFrame, branches: int = 1, template: Template | None = None) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each reply tree, each as one conversation.

    ``messages`` has ``tree``, ``node``, ``parent``, ``role``, ``text`` and ``score``;
    further columns are ignored. An empty table gives an empty one. Repeated nodes of a
    tree are an error of the input; ``thread_messages`` numbers rows without own ids.
    """
    return format_paths(branch_paths(messages, branches), messages, template)


def thread_messages(rows: DataFrame) -> DataFrame:
    """Reply-tree messages of plain conversations: each turn answers the one before.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``. Turns are numbered within
    their conversation by ``turn`` (NULL first), ties by role and text; repeated rows
    are turns of their own. Rows without ``conv_id`` are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("bigint")
    numbered = rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return numbered.select(
        "tree",
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``formatted`` with counts and digests read from the text and the mask alone."""
    template = template or Template()

    @F.pandas_udf(
        "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    def digests(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, masks, strict=True):
            turns, learnt = template.turns(text), template.masked(text, spans)
            said = "".join(f"{role}\n{own}\n" for role, own in turns)
            out.append((len(turns), _sha256(said), len(learnt), _sha256(learnt), len(text)))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(out, columns=names)

    return formatted.select(F.col("tree").alias("conv_id"), digests("formatted", "loss").alias("_d")).select(
        "conv_id", "_d.*"
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: A conversation whose texts look like control strings.
TRAP = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, with one more of control strings: what the formatted text gives back."""
    own = conversations.select("conv_id", "turn", "role", "text")
    trap = conversations.sparkSession.createDataFrame(TRAP, own.schema)
    messages = cut(thread_messages(own.unionByName(trap)), "chat-messages")
    return read_back(format_trees(messages))

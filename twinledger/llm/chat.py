"""Chat formatting: best root-to-leaf paths of reply trees, one conversation text per path."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, pick
from twinledger.session import materialise

# The template. A turn is ``### role: text</turn>`` and a line end; in roles and texts
# a backslash goes before ``\``, ``#`` and ``<``, in roles also before ``:``.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
LEARNT_ROLE = "assistant"

_TURN = re.compile(
    r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, also: str = "") -> str:
    for mark in "\\#<" + also:
        text = text.replace(mark, "\\" + mark)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The text of a conversation and the spans (code points) under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role, ":") + MIDDLE, escape(text)
        if role == LEARNT_ROLE:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += head, body, TAIL
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of ``format_turns``; raises on a text that it didn't make."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def reply_chain(rows: DataFrame) -> DataFrame:
    """(conv, msg, parent, role, text, score) of linear conversations: each turn answers the one before.

    Turns with equal numbers, repeated rows among them, follow each other by role and text; a null
    turn number comes first. Rows of a null conv_id are one conversation.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return (
        pick(rows, "turn", "role", "text", conv="conv_id")
        .withColumn("msg", F.row_number().over(order).cast("long"))
        .select(
            "conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.lit(0.0).alias("score"),
        )
    )


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv, rank, place, msg): the ``top`` root-to-leaf paths of each conversation by score.

    ``messages`` has (conv, msg, parent, score). Self-joins double the reach of every message per
    round, so a thread of depth d takes log2(d) rounds, of which those that reached their root sit out
    the rest: each learns its depth and the sum of scores up
    to its root. Leaves are ranked by that sum, then by depth, then by the smaller msg; the chosen ones
    are walked up over the same jumps. A parent that isn't there makes a root; messages that only hang
    on a cycle of parents have no path. Null scores count 0, a null msg is no message. All joins are on
    (conv, msg), so a conversation with a third of all messages is spread like any other.
    """
    base = pick(messages, "conv", "msg", "parent", "score").where("msg IS NOT NULL").select(
        F.coalesce(F.col("conv").cast("string"), F.lit("null")).alias("c"), "conv", "msg", "parent",
        F.coalesce("score", F.lit(0.0)).alias("score"),
    ).dropDuplicates(["c", "msg"])
    known = base.select("c", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    base = materialise(
        base.join(known, ["c", "parent"], "left")
        .select("c", "conv", "msg", F.when(F.col("there"), F.col("parent")).alias("parent"), "score"),
        "chat-messages",
    )
    limit = max(1, base.count()).bit_length() + 1
    jumps = [base.select("c", "msg", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))]
    while True:
        last = jumps[-1]
        upper = last.select("c", F.col("msg").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        longer = materialise(
            last.where("up IS NOT NULL").join(upper, ["c", "up"], "left").select(
                "c", "msg", F.col("top").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total"),
            ).union(last.where("up IS NULL").select("c", "msg", "up", "depth", "total")),
            "chat-jumps",
        )
        jumps.append(longer)
        if len(jumps) > limit or longer.where("up IS NOT NULL").isEmpty():
            break
    rooted = jumps[-1].where("up IS NULL").select("c", "msg", "depth", "total")
    leaves = rooted.join(base.select("c", F.col("parent").alias("msg")), ["c", "msg"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(
        Window.partitionBy("c").orderBy(F.desc("total"), F.desc("depth"), "msg")
    )).where(F.col("rank") <= top)
    paths = ranked.select("c", "rank", "msg", F.col("depth").alias("place"))
    for power, jump in enumerate(jumps[:-1]):
        up = jump.where("up IS NOT NULL").select("c", "msg", F.col("up"))
        paths = materialise(
            paths.union(paths.join(up, ["c", "msg"]).select("c", "rank", F.col("up").alias("msg"), F.col("place") - 2**power)),
            "chat-paths",
        )
    return base.select("c", "conv", "msg").join(paths, ["c", "msg"]).select("conv", "rank", "place", "msg")


def _format(batches):
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column(2):
            text, spans = format_turns([(t["role"], t["text"]) for t in turns.as_py()])
            texts.append(text)
            masks.append(spans)
        mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array(masks, type=mask)],
            names=["conv", "rank", "formatted", "loss"],
        )


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv, rank, formatted, loss) per chosen path; ``loss`` are the spans to learn from."""
    paths = best_paths(messages, top)
    turns = pick(messages, "conv", "msg", "role", "text").where("msg IS NOT NULL").withColumn(
        "c", F.coalesce(F.col("conv").cast("string"), F.lit("null"))
    ).dropDuplicates(["c", "msg"])
    chosen = paths.withColumn("c", F.coalesce(F.col("conv").cast("string"), F.lit("null"))).select("c", "rank", "place", "msg")
    joined = chosen.join(turns, ["c", "msg"]).select(
        "c", "conv", "rank", F.struct(
            "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("turn"),
    )
    grouped = joined.groupBy("c", "rank").agg(
        F.first("conv").alias("conv"), F.array_sort(F.collect_list("turn")).alias("turns")
    )
    return grouped.select("conv", "rank", "turns").transform(map_batches,
        _format, "conv long, rank int, formatted string, loss array<struct<start: long, end: long>>"
    )


def _digest(batches):
    hexed = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(batch.column(0), batch.column(1), batch.column(2)):
            text = formatted.as_py()
            turns = parse_turns(text)
            learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss.as_py())
            rows.append((
                conv.as_py(), len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)),
                len(learnt), hexed(learnt), len(text),
            ))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(columns, kinds)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say, by parsing them and reading their loss spans."""
    return formatted.select("conv", "formatted", "loss").transform(map_batches,
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


ORACLE = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

"""Conversations rebuilt from message rows.

Method: messages of one thread are cut at long silences; within a conversation every message replies to another one (a
given parent, or else the last message of the other side); Kahn's algorithm sorts this reply graph, taking the earliest
message that is free (time, then id); nodes left over lie on or behind a cycle. Then the alternation of roles in this order
and completeness are checked.

Distribution: silences are found by the range-partitioned scan of ``intervals``, so a busy thread is spread over tasks.
Replies that point back in time never delay anything in Kahn's order; only a reply to a later message does, and no
further than up to that message. So the order is settled in blocks: the spans of such replies, and between them fixed
stretches of time. Within a block rows stream in order of time; what is held is the frontier, the messages that wait for a
later one, so a reply far ahead makes a long block but no large one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeweave.operators.intervals import label_islands
from lifeweave.session import checkpoint, nullable

# Notices that platforms write in place of a message. A point stands for any few characters, as notices
# may be garbled by a wrong encoding.
NOTICES = [
    r"liked a message", r"(reacted|loved|laughed at|emphasi[sz]ed|disliked|questioned) .{0,40}(message|photo)", r"reacted .{1,12} to your message",
    r"(this|the|a) message (was|has been) (deleted|unsent|removed).{0,30}", r"(you|\S{1,40}( \S{1,40})?) (unsent|deleted|removed) a message", r"message unavailable", r"this message is no longer available",
    r"(you )?sent an? (attachment|photo|video|sticker|gif|link|voice message|location|file)", r"(you )?(shared|sent) a (post|story|reel|location|live location)",
    r"(you )?missed an? (video |voice |audio )?call.{0,40}", r"missed (video|voice|audio) (call|chat).{0,40}", r"the (video|audio|voice) (chat|call) ended", r"(you )?(started|joined) an? (video|audio|voice)? ?(chat|call)", r"you are now connected on messenger",
    r"ce message a .{1,8}t.{1,8} supprim.{1,8}", r"vous avez supprim.{1,8} un message", r"vous avez envoy.{1,8} une pi.{1,8}ce jointe", r"appel (vid.{1,8}o )?manqu.{1,8}",
    r"diese nachricht wurde gel.{1,8}scht", r"du hast eine nachricht gel.{1,8}scht", r"verpasster (video|sprach)?anruf", r"(se )?elimin.{1,8} este mensaje", r"este mensaje (fue eliminado|se elimin.{1,8})", r"llamada (de voz |de video )?perdida",
]

SILENCE_S = 8 * 3600.0
#: Roles of the speakers.
ME, OTHER = "me", "other"
#: Stands for no message where rows pass through pandas, which would turn a column with NULLs into doubles.
NOTHING = -(2**63)


def is_notice(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[.!…]+$", "").rlike("(?u)^(" + "|".join(f"(?:{n})" for n in NOTICES) + ")$")


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}\p{Cf}\p{Cc}]+", "") == ""


def fold_name(who: Column) -> Column:
    """A name without differences of case and spacing."""
    return F.lower(F.trim(F.regexp_replace(who, r"[\s\p{Z}]+", " ")))


class Kahn:
    """Kahn's algorithm over the messages of a block that come in order of (time, id).

    A message whose parent has been placed is free at once, and the earliest that can be; one whose parent is yet to come, or
    waits itself, joins the frontier and is placed, with what waits for it, when its parent is. What never is lies on or
    behind a cycle."""

    def __init__(self):
        self.placed = 0
        self.frontier: dict[int, list[tuple[float, int]]] = {}
        self.waiting: dict[int, tuple[float, int]] = {}

    def add(self, ts: float, i: int, parent: int, late: bool) -> list[tuple[int, int]]:
        """(id, turn) of what is placed once message ``i`` has come. ``late``: its parent comes after it."""
        if late or parent in self.waiting:
            self.frontier.setdefault(parent, []).append((ts, i))
            self.waiting[i] = (ts, parent)
            return []
        out, free = [], [(ts, i)]
        while free:
            _, k = heapq.heappop(free)
            out.append((k, self.placed))
            self.placed += 1
            for child in self.frontier.pop(k, ()):
                del self.waiting[child[1]]
                heapq.heappush(free, child)
        return out


def _blocks(messages: DataFrame, conversation: list[str], stretch: float) -> DataFrame:
    """``messages`` with block and tied: the spans of replies to later messages, and between them fixed stretches of time."""
    parent = messages.select(F.col("id").alias("reply_to"), F.col("ts").alias("parent_ts"), *[F.col(c).alias(f"parent_{c}") for c in conversation])
    linked = messages.where(F.col("reply_to").isNotNull()).join(parent, "reply_to")
    for c in conversation:
        linked = linked.where(F.col(c) == F.col(f"parent_{c}"))
    late = linked.where((F.col("parent_ts") > F.col("ts")) | ((F.col("parent_ts") == F.col("ts")) & (F.col("reply_to") >= F.col("id"))))
    messages = messages.join(late.select("id", F.lit(True).alias("late")), "id", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    spans = late.select(*conversation, F.col("ts").alias("s"), F.col("parent_ts").alias("e"), F.lit(NOTHING).alias("id"), F.lit(NOTHING).alias("reply_to"), F.lit(None).cast("string").alias("role"), F.lit(True).alias("late"), F.lit(True).alias("span"))
    points = messages.select(*conversation, F.col("ts").alias("s"), F.col("ts").alias("e"), "id", F.coalesce("reply_to", F.lit(NOTHING)).alias("reply_to"), "role", "late", F.lit(False).alias("span"))
    islands = label_islands(spans.unionByName(points), conversation, "s", "e", "tie")
    ties = islands.where("span").select(*conversation, "tie").distinct().withColumn("tied", F.lit(True))
    rows = islands.where("NOT span").join(ties, [*conversation, "tie"], "left")
    block = F.when(F.col("tied"), F.col("tie")).otherwise(F.floor(F.col("s") / stretch) * stretch)
    return rows.select(*conversation, F.col("s").alias("ts"), "id", "reply_to", "role", "late", F.coalesce("tied", F.lit(False)).alias("tied"), block.cast("double").alias("block"))


def order_replies(messages: DataFrame, conversation: list[str], stretch: float = 21_600.0) -> DataFrame:
    """Kahn's order of every conversation's reply graph: conversation, ts, id, reply_to, role, block, turn (bigint) and
    left_over (on or behind a cycle within its block; turn is then NULL). The order of a conversation is that of (block, turn).

    ``messages`` has the columns of ``conversation`` (strings), id (unique), ts, role and, if replies are given, reply_to
    (an id or NULL). A reply to a message that is missing or in another conversation counts as a reply to nothing, one to
    itself as a cycle. Without the column reply_to each message replies to the last one of another role before it."""
    if "reply_to" in messages.columns:
        rows = _blocks(messages, conversation, stretch)
    else:
        # such replies point back in time, so any cut leaves the order as it is; the parent may lie before the block, so the
        # last message of each role is carried over from earlier blocks, in one row a block
        rows = messages.select(*conversation, "ts", "id", "role", F.lit(False).alias("late"), F.lit(False).alias("tied"), (F.floor(F.col("ts") / stretch) * stretch).cast("double").alias("block"))
        ends = rows.groupBy(*conversation, "block").agg(*[F.max_by("id", F.when(F.col("role") == r, F.struct("ts", "id"))).alias(f"last_{r}") for r in (ME, OTHER)])
        earlier = Window.partitionBy(*conversation).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*conversation, "block", *[F.last(f"last_{r}", ignorenulls=True).over(earlier).alias(f"last_{r}") for r in (ME, OTHER)])
        before = Window.partitionBy(*conversation, "block").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
        last = lambda role: F.coalesce(F.last(F.when(F.col("role") == role, F.col("id")), ignorenulls=True).over(before), F.col(f"last_{role}"))
        rows = rows.join(ends, [*conversation, "block"]).withColumn("reply_to", F.when(F.col("role") == ME, last(OTHER)).otherwise(last(ME))).drop(f"last_{ME}", f"last_{OTHER}")
    keys = [*conversation, "block", "tied"]
    rows = rows.withColumn("reply_to", F.coalesce("reply_to", F.lit(NOTHING)))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "ts", "id")
    schema = nullable(rows.drop("late").select(*[c for c in rows.columns if c != "late"], F.lit(0).cast("bigint").alias("turn"), F.lit(False).alias("left_over")).schema)
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: tuple | None = None
        graph = Kahn()
        held: dict[int, tuple] = {}  # rows of the frontier
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), dtype=bool)
            new[0] = block is None or tuple(pdf[c].iat[0] for c in keys) != block
            for c in keys:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            late = pdf["late"].to_numpy(dtype=bool)
            start = np.flatnonzero(new).tolist()
            at, turn, left = np.arange(len(pdf)), np.empty(len(pdf), dtype=object), np.zeros(len(pdf), dtype=bool)
            extra: list[tuple] = []
            rest = pdf.drop(columns="late")
            for a, b in zip([0, *start] if not new[0] else start, [*start, len(pdf)] if not new[0] else [*start[1:], len(pdf)]):
                if a == b:
                    continue
                if new[a]:
                    extra += [(*row, None, True) for row in held.values()]
                    graph, held = Kahn(), {}
                if not held and not late[a:b].any():  # nothing waits: the order is that of time
                    turn[a:b] = at[: b - a] + graph.placed
                    graph.placed += b - a
                    continue
                here = {}
                for k, ts, i, parent, is_late in zip(range(a, b), pdf["ts"].iloc[a:b].tolist(), pdf["id"].iloc[a:b].tolist(), pdf["reply_to"].iloc[a:b].tolist(), late[a:b].tolist()):
                    here[i] = k
                    for j, t in graph.add(ts, i, parent, is_late):
                        if j in here:
                            turn[here[j]] = t
                        else:
                            extra.append((*held.pop(j), t, False))
                for i in graph.waiting:
                    if i in here:  # waits beyond this batch or its block
                        held[i] = tuple(rest.iloc[here[i]].tolist())
                        left[here[i]] = True
            block = tuple(pdf[c].iat[-1] for c in keys)
            out = rest[~left].assign(turn=pd.array(turn[~left], dtype="Int64"), left_over=False)
            yield pd.concat([out, _frame(extra, columns)]) if extra else out
        if held:
            yield _frame([(*row, None, True) for row in held.values()], columns)

    return ordered.mapInPandas(run, schema).withColumn("reply_to", F.nullif("reply_to", F.lit(NOTHING)))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(turn=pd.array(out["turn"].tolist(), dtype="Int64"))


def messages_of(social: DataFrame) -> DataFrame:
    """The messages that count, once each: person, source, name (of the counterpart, folded), ts, role, id.

    A message has a person, source, counterpart, time (not 0) and a text that is neither blank nor a notice; of rows equal
    in person, source, who, kind, ts and text the smallest id stands."""
    rows = social.where(F.col("kind").isin("message_in", "message_out") & F.col("ts").isNotNull() & ~F.isnan("ts") & (F.col("ts") != 0) & F.col("person").isNotNull() & F.col("source").isNotNull())
    rows = rows.where((fold_name(F.col("who")) != "") & ~is_blank(F.col("text")) & ~is_notice(F.col("text")))
    once = rows.groupBy("person", "source", "who", "kind", F.col("ts").cast("double").alias("ts"), "text").agg(F.min("social_id").alias("id"))
    return once.select("person", "source", fold_name(F.col("who")).alias("name"), "ts", F.when(F.col("kind") == "message_out", ME).otherwise(OTHER).alias("role"), "id")


def alternations(ordered: DataFrame, key: list[str]) -> DataFrame:
    """key and alternations: how often the role changes from one message of Kahn's order to the next. Changes within a block
    are counted there; from block to block only the roles at its ends are compared."""
    inside = Window.partitionBy(*key, "block").orderBy("turn")
    blocks = ordered.withColumn("turned", (F.col("role") != F.lag("role").over(inside)).cast("bigint")).groupBy(*key, "block").agg(
        F.sum(F.coalesce("turned", F.lit(0))).alias("turned"), F.min_by("role", "turn").alias("first"), F.max_by("role", "turn").alias("last"),
    )
    along = Window.partitionBy(*key).orderBy("block")
    return blocks.withColumn("edge", F.coalesce((F.col("first") != F.lag("last").over(along)).cast("bigint"), F.lit(0))).groupBy(*key).agg(F.sum(F.col("turned") + F.col("edge")).alias("alternations"))


def conversations(social: DataFrame, silence: float = SILENCE_S) -> DataFrame:
    """Kept conversations, one row a message: conv_id (its smallest id), id, ts, role, reply_to, block, turn.

    A conversation is a person's messages with one counterpart on one source without a silence of more than ``silence``.
    It is kept if in Kahn's order of its replies the role changes at least once (both sides speak, one answers the other) and
    no message is left over by a cycle. Ties in time go by id; an empty table gives no rows; rows with unknown values in the
    columns that make a message are no messages; extra columns are ignored."""
    key = ["person", "source", "name", "start"]
    rows = label_islands(messages_of(social), ["person", "source", "name"], "ts", F.col("ts") + silence, "start")
    rows = order_replies(rows.withColumn("start", F.col("start").cast("string")), key)
    # the messages are settled once; the checks and the rows start from there
    rows = checkpoint(rows)
    whole = rows.groupBy(*key).agg(F.min("id").alias("conv_id"), F.count_if("left_over").alias("broken")).where("broken = 0")
    kept = whole.join(alternations(rows, key).where("alternations > 0"), key)
    return rows.join(kept.select(*key, "conv_id"), key).select("conv_id", "id", "ts", "role", "reply_to", "block", "turn")

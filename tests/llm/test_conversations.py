import random

import pytest

from lifeweave.llm import conversations as c

SCHEMA = "social_id long, person string, ts double, source string, kind string, text string, who string"
IN, OUT = "message_in", "message_out"


def kept(spark, rows):
    got = {}
    for r in c.conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["conv_id"], []).append((r["block"], r["turn"], r["id"]))
    return {k: [i for _, _, i in sorted(v)] for k, v in got.items()}


def test_conversations(spark):
    h = 3600.0
    rows = [
        (5, "a", 1000.0, "x", OUT, "hi", "Bo  Li"), (3, "a", 1000.0 + 8 * h, "x", IN, "yes", " bo li"), (9, "a", 1000.0 + 8 * h, "x", OUT, "ok", "BO LI"),
        (10, "a", 1001.0 + 16 * h, "x", IN, "late", "bo li"),  # alone after a longer silence
        (11, "a", 1000.0, "y", OUT, "other source", "bo li"), (12, "b", 1.0, "x", OUT, "one", "z"), (13, "b", 2.0, "x", IN, "This message was deleted", "z"), (14, "b", 3.0, "x", IN, " ​ ", "z"), (15, "b", 0.0, "x", IN, "no time", "z"), (16, "b", None, "x", IN, "no time", "z"), (17, "b", 5.0, "x", IN, "t", None),
        (18, "b", 5.0, "x", IN, "t", "  "), (19, "b", 6.0, "x", IN, None, "z"), (20, None, 6.0, "x", IN, "t", "z"), (21, "a", 1000.0, "x", OUT, "hi", "Bo  Li"), (22, "a", 1002.0, "x", "post", "p", "bo li"),
    ]
    assert kept(spark, rows) == {3: [5, 3, 9]}
    assert kept(spark, rows[:0]) == {}


def test_notices(spark):
    yes = ["You sent an attachment.", "Missed video call", "The video chat ended.", "Ce message a été supprimé", "Ce message a Ã©tÃ© supprimÃ©", "Diese Nachricht wurde gelÃ¶scht", "Liked a message", "sent a sticker."]
    no = ["we missed the stop at Marby", "call you later", "I liked a message you sent", "thanks!"]
    got = spark.createDataFrame([(x,) for x in yes + no], "t string").select(c.is_notice(c.F.col("t"))).collect()
    assert [r[0] for r in got] == [True] * len(yes) + [False] * len(no)


def brute(nodes, parents):
    """Kahn's order by repeated search."""
    ids, seen, order = {i for _, i in nodes}, set(), []
    while True:
        free = sorted(n for n in nodes if n[1] not in seen and (parents.get(n[1]) is None or parents[n[1]] not in ids or parents[n[1]] in seen))
        if not free:
            return order, sorted(i for i in ids if i not in seen)
        seen.add(free[0][1])
        order.append(free[0][1])


@pytest.mark.parametrize("seed", range(3))
def test_order_in_blocks_equals_one_graph(spark, seed):
    r = random.Random(seed)
    nodes = [(float(r.randint(0, 3000)), i) for i in range(150)]
    parents = {}
    for _, i in nodes:
        if r.random() < 0.6:
            near = [j for u, j in nodes if abs(u - nodes[i][0]) < (60 if r.random() < 0.9 else 3000)]
            parents[i] = r.choice(near)
    if seed == 2:
        parents = {i: p for i, p in parents.items() if nodes[p] < nodes[i] or r.random() < 0.1}
    df = spark.createDataFrame([("k", i, t, "me", parents.get(i)) for t, i in nodes] + [("l", 1000, 5.0, "me", 3)], "conv string, id long, ts double, role string, reply_to long")
    rows = [x for x in c.order_replies(df, ["conv"], stretch=100.0).collect() if x["conv"] == "k"]
    order, left = brute(nodes, parents)
    if not left:
        assert [x["id"] for x in sorted(rows, key=lambda x: (x["block"], x["turn"]))] == order
    assert len(rows) == 150 and any(x["left_over"] for x in rows) == bool(left)


def test_cycles(spark):
    df = spark.createDataFrame([("k", 1, 1.0, "me", 2), ("k", 2, 2.0, "me", 1), ("k", 3, 3.0, "me", 3), ("k", 4, 4.0, "me", None)], "conv string, id long, ts double, role string, reply_to long")
    assert {x["id"]: x["left_over"] for x in c.order_replies(df, ["conv"]).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_a_reply_far_ahead_holds_only_what_waits(spark):
    n = 3000
    rows = [("k", i, float(i), "me", n - 1 if i == 5 else 5 if i in (6, 2000) else 6 if i == 7 else i - 1 if i > 100 and i != 2001 else None) for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = c.order_replies(spark.createDataFrame(rows, "conv string, id long, ts double, role string, reply_to long"), ["conv"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x["id"] for x in sorted(got, key=lambda x: (x["block"], x["turn"]))] == brute([(t, i) for _, i, t, _, _ in rows], {i: p for _, i, _, _, p in rows})[0]


def test_alternations(spark):
    rows = [("k", i, i * 5000.0, c.ME if r == "m" else c.OTHER) for i, r in enumerate("mmoommomoo")] + [("l", 50 + i, i * 9000.0, c.ME) for i in range(5)]
    ordered = c.order_replies(spark.createDataFrame(rows, "conv string, id long, ts double, role string"), ["conv"])
    assert {x["conv"]: x["alternations"] for x in c.alternations(ordered, ["conv"]).collect()} == {"k": 5, "l": 0}


def test_replies_reach_over_block_edges(spark):
    r = random.Random(4)
    rows = [(i, p, float(r.randint(0, 300_000)), "x", r.choices([IN, OUT], [1, k])[0], f"text {i}", "z") for k, p in ((1, "a"), (30, "b")) for i in range(k * 1000, k * 1000 + 150)]
    want = {}
    for p in "ab":
        mine = sorted((x[2], x[0], x[4]) for x in rows if x[1] == p)
        last, at = {}, None
        for ts, i, kind in mine:
            last = {} if at is not None and ts - at > c.SILENCE_S else last
            want[i], last[kind], at = last.get(IN if kind == OUT else OUT), i, ts
    got = {x["id"]: x for x in c.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) > 250 and {i: x["reply_to"] for i, x in got.items()} == {i: want[i] for i in got}
    assert sum(x["reply_to"] is not None and got[x["reply_to"]]["block"] < x["block"] for x in got.values()) > 10

import random

from pyspark.sql import functions as F

from lifeweave.llm import encoding as e

CLEAN = ["Café am See", "Grüße aus Köln", "El niño y la montaña", "SÃO PAULO", "MANHÃ EM CASA", "Où êtes-vous?", "Улица Мира", "Добрый вечер", "naïve plan…", "“home” – sweet", "plain text", "Île de Ré", "Łódka na jeziorze", "£4 for tea", "桜がきれい"]


def rows(spark, garbled):
    data = [("social", i, "s", t) for i, t in enumerate([f"{t} {k}" for k in range(12) for t in CLEAN])]
    data += [("social", 10_000 + i, "s", t) for i, t in enumerate(garbled)] + [("places", 1, None, None), ("places", 2, None, ""), ("places", 3, "s", "a" * 200_000 + " Café"), ("photos", 4, "s", "CafÃ© " * 20_000)]
    return spark.createDataFrame(data, "tbl string, row_id long, source string, text string")


def test_found_and_restored(spark):
    chains = [("latin-1", "Café am See"), ("cp1252", "“home” – sweet"), ("mac_roman", "Grüße aus Köln"), ("cp1251", "El niño y la montaña"), ("cp850", "Où êtes-vous?"), ("latin-1", "Улица Мира"), ("cp1252", "naïve plan…"), ("mac_roman", "桜がきれい")]
    decode = lambda b, c: "".join(next(k for k, v in e._table(c).items() if v == x) if x > 127 else chr(x) for x in b)
    garbled = [decode(t.encode(), c) for c, t in chains]
    garbled += [decode(decode("Café am See".encode(), "cp1252").encode(), "cp1252"), "Улица Мира".encode("cp1251").decode("cp1252"), "Добрый вечер".encode("koi8_r").decode("cp1251"), "Добрый " + decode("вечер".encode(), "latin-1")]
    want = [t for _, t in chains] + ["Café am See", "Улица Мира", "Добрый вечер", "Добрый вечер"]
    lost = ["Gr��e aus K��ln", "naÃ¯ve planâ¦"]
    out = {r["row_id"]: r for r in e.repair(rows(spark, garbled + lost)).where("tbl = 'social'").collect()}
    assert sorted(out) == list(range(10_000, 10_000 + len(garbled) + len(lost)))
    assert [out[10_000 + i]["restored"] for i in range(len(garbled))] == want
    assert all(out[10_000 + len(garbled) + i]["restored"] is None for i in range(len(lost)))


def test_edges(spark):
    df = rows(spark, [])
    out = e.repair(df.withColumn("grp", F.lit("clash")).withColumn("n", F.lit(0))).collect()
    assert [(r["tbl"], r["row_id"]) for r in out] == [("photos", 4)] and out[0]["restored"] == "Café " * 20_000
    assert e.repair(df.limit(0)).collect() == []
    assert e.repair(spark.createDataFrame([("t", i, "s", "CafÃ© bar") for i in range(3)] + [("t", 9, "s", "plain café")], df.schema)).count() == 3


def test_chain_probabilities_are_the_same_in_tasks(spark):
    texts = rows(spark, ["CafÃ© am See"] * 5 + ["GrÃ¼Ã\x9fe"] * 3).where("text <> ''").groupBy(F.col("tbl").alias("grp"), "text").agg(F.count("*").cast("double").alias("n"))
    model = e.Characters(e._sum_pairs(texts, lambda t, _: [(t, 1.0)]))
    here, there = e._priors(texts, model, 4), e._priors(texts, model, 4, most=0)
    assert here.keys() == there.keys() and len(here) == 3
    assert all(abs(here[g][c] - there[g][c]) < 1e-9 for g in here for c in here[g]) and here["social"]["utf-8 as latin-1"] > e._START["utf-8 as latin-1"]


def test_pairs_are_those_of_symbols():
    for text in [*CLEAN, "", "a^b$ 中文 \u200d 😀 ‰"]:
        s = ["^", *[e.symbol(c)[0] for c in text], "$"]
        assert list(e.pairs(text)) == list(zip(s, s[1:]))


def test_restored_texts_are_right():
    """Accuracy of the repair on texts of which the original is known: at least nine in ten."""
    r, right, whole = random.Random(3), 0, 0
    counts: dict = {}
    for t in CLEAN * 20:
        for p in e.pairs(t):
            counts[p] = counts.get(p, 0.0) + 1.0
    model = e.Characters(counts)
    for _ in range(300):
        text, codec = r.choice([t for t in CLEAN if not t.isascii()]), r.choice(e.UTF8_AS[:4])
        shown = "".join(next(k for k, v in e._table(codec).items() if v == x) if x > 127 else chr(x) for x in text.encode())
        found = e.candidates(shown)
        post = e.posterior(found, model, e._START)
        whole += 1
        right += found[max(range(len(found)), key=post.__getitem__)][1] == text
    assert right >= 0.9 * whole


def test_round_trips():
    for codec in e.UTF8_AS:
        undo = e._UTF8[f"utf-8 as {codec}"]
        for text in CLEAN:
            shown = "".join(next(k for k, v in e._table(codec).items() if v == x) if x > 127 else chr(x) for x in text.encode())
            assert shown.isascii() or undo(shown) == text
    assert e.candidates("ascii only") == [("none", "ascii only")]

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifeweave.llm import leaks, packing, quality, variety

needs_tokens = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary here")


# ---- packing


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(20):
        lengths = sorted(r.sample(range(1, 40), 8))
        h = {x: r.randint(1, 9) for x in lengths}
        cost = lambda cuts: sum(n * (min(c for c in cuts if c >= x) - x) for x, n in h.items())
        got = packing.boundaries(h, 40, buckets=3)
        best = min(cost(set(c) | {lengths[-1]}) for k in range(3) for c in itertools.combinations(lengths, k))
        assert len(got) <= 3 and cost(got) == best
    assert packing.boundaries({}, 40) == []
    # every length up to a large capacity, against the plain recurrence
    h = {x: r.randint(0, 50) for x in range(1, 4097, 7)} | {4096: 3}
    got, lengths = packing.boundaries(h, 4096, buckets=20), [x for x in sorted(h) if h[x]]
    n, t = np.cumsum([0] + [h[x] for x in lengths]), np.cumsum([0] + [h[x] * x for x in lengths])
    cost = np.array([[lengths[j - 1] * (n[j] - n[i]) - (t[j] - t[i]) if i < j else np.inf for j in range(len(lengths) + 1)] for i in range(len(lengths) + 1)])
    best = cost[0].copy()
    for _ in range(19):
        best = np.minimum(best, (best[:, None] + cost).min(axis=0))
    assert len(got) <= 20 and sum(k * (min(c for c in got if c >= x) - x) for x, k in h.items() if k) == best[-1]


def test_plans_hold_everything_and_overflow_nothing():
    r = random.Random(2)
    for _ in range(50):
        widths = sorted(r.sample(range(1, 101), 6))
        counts = [r.randint(0, 500) for _ in widths]
        put = [0] * 6
        for alike, fill in packing.plan(counts, widths, 100, fill_rest := r.random() < 0.5):
            assert fill_rest or len(fill) == 1
            assert alike > 0 and sum(t * widths[b] for b, t in fill) <= 100
            for b, t in fill:
                put[b] += alike * t
        assert put == counts


@needs_tokens
def test_packing(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["river", "bridge", "the", "old", "photograph"]) for _ in range(r.choice([1, 5, 40, 120, 700]))) for _ in range(300)] + ["", None, "<|endoftext|>", "x" * 5000, texts_again := "same text"] + [texts_again] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("tokens", F.lit("clash"))
    caps = {1: 64, 2: 256, 3: 100_000}
    rows = packing.pack(df, caps).collect()
    assert {x["doc_id"] for x in packing.pack(df, caps, fill_rest=False).collect()} == {x["doc_id"] for x in rows}
    tokens = {x["doc_id"]: x["tokens"] for x in packing.count_tokens(df).collect()}
    assert tokens[300] == tokens[301] == 0 and tokens[302] > 1
    for k, c in caps.items():
        mine = [x for x in rows if x["size_id"] == k]
        fill, parts = {}, {}
        for x in mine:
            fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
            parts.setdefault(x["doc_id"], []).append((x["piece"], x["first_token"], x["tokens"]))
        assert max(fill.values()) <= c and sorted(fill) == list(range(len(fill)))
        assert {d: sum(p[2] for p in ps) for d, ps in parts.items()} == {d: n for d, n in tokens.items() if n}
        assert all(len(ps) == 1 or tokens[d] > c for d, ps in parts.items())
        assert all(p[1] == i * c and p[0] == i for ps in parts.values() for i, p in enumerate(sorted(ps)))
        assert len(fill) <= 1.35 * -(-sum(tokens.values()) // c) + 1
    assert packing.pack(df.limit(0), caps).collect() == [] and packing.pack(df, {}).collect() == []
    assert {x["size_id"]: x["fill"] for x in packing.fill_rates(packing.pack(df, caps), caps).collect()}[1] > 0.75


# ---- leaks


def brute_leaks(documents, items):
    """Pairs by comparing every word window, for unchanged passages."""
    out = set()
    for d, text in documents:
        f = leaks.folded(text or "")
        for i, t in items:
            words = leaks.words_of(t)
            n = -(-len(words) // 3)
            n = max(n, min(12, len(words)))
            if any("".join(words[k : k + n]) in f for k in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_wu_manber_finds_every_occurrence():
    r = random.Random(4)
    items = [(i, sentence(r, r.randint(5, 60))) for i in range(40)]
    p = leaks.Patterns([leaks.Item(i, leaks.words_of(t)) for i, t in items])
    text = leaks.folded(" ".join(sentence(r, 30) + " " + t[: r.randint(10, 300)] for _, t in items))
    want = sorted((i, text[i : i + leaks.LENGTH]) for i in range(len(text)) if text[i : i + leaks.LENGTH] in p.where)
    assert sorted(p.occurrences(text)) == want and want
    assert list(p.occurrences("short")) == [] and leaks.Patterns([]).passages("some text that is long enough to search") == {}


def test_leaks(spark):
    r = random.Random(5)
    rule = "Read the notes below and then answer the question in one short sentence please."
    items = [(i, f"{rule} {sentence(r, 45)}") for i in range(12)]
    words = [t.split() for _, t in items]
    own = [w[14:] for w in words]
    docs = {
        1: sentence(r, 50) + " " + items[0][1] + " " + sentence(r, 50), 2: " ".join(own[1][5:27]).upper().replace(" ", " -\n", 3), 3: " ".join(own[2][:9]), 4: rule + " " + sentence(r, 90),
        5: " ".join("zzz" if k % 12 == 6 else w for k, w in enumerate(own[3])), 6: " ".join("zzz" if k % 4 == 2 else w for k, w in enumerate(own[4])), 7: " ".join(f"<b>{w}</b>" if k % 3 == 0 else f"“{w}”," for k, w in enumerate(own[5])),
        8: " ".join(own[6][:20]) + " " + " ".join(own[7][3:25]), 9: None, 10: "", 11: sentence(r, 30_000) + " " + items[8][1] + sentence(r, 30_000), 12: items[0][1], 13: rule, 14: " ".join(w[:2] + "\n" + w[2:] for w in own[9]),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = {(x["doc_id"], x["item_id"]) for x in leaks.leaks(d, it).collect()}
    assert found == {(1, 0), (2, 1), (5, 3), (7, 5), (8, 6), (8, 7), (11, 8), (12, 0), (14, 9)}
    assert {p for p in found if p[0] not in (5,)} == brute_leaks([x for x in docs.items() if x[0] not in (5,)], [(i, " ".join(w)) for i, w in enumerate(own)])
    assert leaks.leaks(d.limit(0), it).collect() == [] and leaks.leaks(d, it.limit(0)).collect() == []


def test_items_that_share_a_text_are_all_found(spark):
    r = random.Random(7)
    same, short = sentence(r, 40), sentence(r, 14)
    items = [(i, same if i % 2 else same.upper().replace(" ", " - ")) for i in range(9)] + [(3, same)] + [(20, short)] + [(30 + i, f"{short} {sentence(r, 30)}") for i in range(9)] + [(50, sentence(r, 40))]
    docs = [(1, sentence(r, 50) + " " + same + " " + sentence(r, 50)), (2, " ".join(same.split()[10:30])), (3, sentence(r, 20) + " " + short), (4, sentence(r, 90))]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()
    assert sorted(tuple(x) for x in found) == [(d, i) for d in (1, 2) for i in range(9)] + [(3, 20)]


def test_a_third_of_a_short_item_is_a_leak(spark):
    r = random.Random(8)
    rule, own = sentence(r, 10), [sentence(r, 14).split() for _ in range(2)]
    items = spark.createDataFrame([(i, f"{rule} {' '.join(w)}") for i, w in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(own[0][2:11])), (2, " ".join(own[1][2:9])), (3, rule), (4, " ".join([*rule.split()[4:], *own[0][:4]]))], "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leaks.leaks(docs, items).collect()} == {(1, 0)}


@pytest.mark.parametrize("copies", [7, 100])
def test_copies_of_an_item_are_all_found(spark, copies):
    r = random.Random(9)
    same, other = sentence(r, 60), sentence(r, 60)
    items = spark.createDataFrame([(i, same) for i in range(copies)] + [(1000 + i, f"{same} {sentence(r, 60)}") for i in range(9)] + [(2000, other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, sentence(r, 30) + " " + same), (2, other), (2, other)], "doc_id long, text string")
    found = sorted(tuple(x) for x in leaks.leaks(docs, items).select("doc_id", "item_id").collect())
    assert found == [(1, i) for i in range(copies)] + [(2, 2000)] * 2


def test_passes_change_nothing(spark):
    r = random.Random(10)
    rule = "Read the notes below and then answer the question in one short sentence please."
    items = spark.createDataFrame([(i, f"{rule} {sentence(r, 40)}") for i in range(30)], "item_id long, text string")
    texts = [x["text"].split() for x in items.collect()]
    docs = spark.createDataFrame([(i, " ".join(w[k : k + 24])) for i, w in enumerate(texts) for k in (0, 20)], "doc_id long, text string")
    one, many = ({tuple(x) for x in leaks.leaks(docs, items, pass_chars=n).collect()} for n in (10**6, 1000))
    assert one == many and len(one) == 30  # a passage that is half instructions is no leak


def test_scripts_without_spaces(spark):
    r = random.Random(11)
    items = [(i, "".join(r.choice("山川田中日月火水木金土上下左右大小高低新古") for _ in range(90)) + "。") for i in range(4)]
    docs = [(1, "昨日" + items[0][1][13:55] + "です"), (2, items[1][1][:20]), (3, "".join("々" if k % 11 == 5 else c for k, c in enumerate(items[2][1])))]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == {(1, 0), (3, 2)}
    assert leaks.words_of("山川 ab-cd กิน") == ["山", "川", "ab", "cd", "ก", "น"] and leaks.folded("山川 ab-cd กิน") == "".join(leaks.words_of("山川 ab-cd กิน"))


# ---- quality


PROSE = ["We walked along the river until it was dark, and then we had soup at the old inn.", "Wir haben den Zug verpasst, weil die Uhr am Bahnhof nicht richtig ging.", "Nous avons marché le long de la rivière sans rencontrer personne.", "No había nadie en la estación, pero la señora nos explicó el camino.",
         "we walked along the river until it was dark and then we had soup at the old inn", "We walked along the ri\nver until it was dark, and\nthen we had soup.", "> We walked along the river\n> until it was dark.", "Мы шли вдоль реки, и было уже темно, когда мы пришли домой.", "昨日は海に行きました。とても楽しかったです。", "We took:\nthe boat and the old train, because it was late and nobody wanted to walk home in the rain.\n- soup"]
OTHER = ["", "  \n ", None, "...", "- soup\n- bread\n- ask my cousin about the boat", "[ ] tent\n[ ] map\n[x] torch", "1. tower\n2. old bridge\n3. market", "09:15 tower\n10:20 by train to Marby\n11:00 soup", "a\tb\tc\n1\t2\t3\n4\t5\t6", "| km | place |\n| --- | --- |\n| 3 | Marby |", "day;km;town\n2020-01-01;3;Marby", "12.5    Marby     2020-01-01\n3.1     Linna     2020-02-02",
         "%$#@!~^&*(_+=<>", "qG8qbHHK3UWHZRNbU81R3o7081BqY9ggiwpdSSBZfpUrcsOb4kg85EclvmgribTiqn3ziWhf6", "jgxhrvch rlncvjrhhmxjv vssc xlvcp pjhzbd rfbdzrmlxt sbbxxwjtjv", "ISO=100 FNumber=5.5 GPSAltitude=3\nISO=200 FNumber=1.8 GPSAltitude=9", "[1234] WARN part 5fdf4099 skipped code=99\n[99] WARN part 1 skipped code=2", "pier Marby steep pier Marby steep pier Marby steep pier Marby", "tower, Marby, old bridge (two hours), soup, by train to Linna, tent", "geo:1.5,2.5\ngeo:3.5,4.5", "tent\nmap\ntorch\nold hat"]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert quality.judge(text, quality.describe([text])[0]) == "prose"


@pytest.mark.parametrize("text", OTHER)
def test_other_forms(text):
    assert quality.judge(text, quality.describe([text])[0]) != "prose"


@pytest.mark.parametrize("text", ["the lights of the harbour " * 40, "the lights of the harbour " * 4, "\n\n".join(PROSE[:3] + PROSE[:2] * 2), "\n\n".join([PROSE[0]] * 3 + [PROSE[1]]), "click here to win the prize of your life " * 300, "we walked along the river until it was dark and then had soup at the old inn by the bridge " * 5, "bcdf77 ghjk88 lmnp99 qrst11 is the.\n" * 3, "bcdf77 ghjk88 lmnp99 qrst11 is the."])
def test_repetition_is_junk(text):
    assert quality.judge(text, quality.describe([text])[0]) == "junk"


def test_boilerplate():
    page = "We use cookies to give you the best walk through our pages.\nRead our cookie policy before you go on.\nSubscribe to our newsletter to hear about the river first."
    judged = lambda t: quality.judge(t, quality.describe([t])[0])
    assert judged(page) == "boilerplate" and judged("\n\n".join([page] * 3)) == "junk"
    assert judged(page + "\n" + "\n".join(PROSE[:4] * 2)) == "prose"


def test_dominant_n_grams_equal_a_plain_count():
    r = random.Random(12)
    texts = [" ".join(r.choice(["bo", "Lin", "the", "aa", "river"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    for text, row in zip(texts, quality.describe(texts)):
        words, v = text.lower().split(), dict(zip(quality.STATISTICS, row))
        for n in quality.GRAMS:
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            most = max(((grams.count(g), sum(map(len, g))) for g in grams), default=(0, 0))
            want = min(1.0, most[0] * most[1] / sum(map(len, words))) if most[0] > 1 and len(words) >= 2 * n else 0.0
            assert v[f"top_{n}gram_ratio"] == pytest.approx(want)


@pytest.mark.parametrize("text", ["I know that he is here and I know that he is not there because the door was open all night.", "\n\n".join(PROSE[:3] + PROSE[:2]), "\n\n".join(PROSE[:3] * 2)])
def test_a_second_time_is_no_junk(text):
    assert quality.judge(text, quality.describe([text])[0]) == "prose"


def test_statistics(spark):
    v = dict(zip(quality.STATISTICS, quality.describe(["One two.\nOne two.\n\n3 four!"])[0]))
    assert (v["n_words"], v["n_lines"], v["mean_word_length"], v["end_punctuation_ratio"]) == (5, 3, 3.2, 1.0)
    assert v["duplicate_line_ratio"] == pytest.approx(8 / 23) and v["symbol_ratio"] == pytest.approx(3 / 20) and v["digit_ratio"] == pytest.approx(1 / 20)
    assert quality.describe([None]) == quality.describe([""])
    assert dict(zip(quality.STATISTICS, quality.describe(["a b a b a b a b"])[0]))["top_2gram_ratio"] == 1.0
    df = spark.createDataFrame([(1, "x. " * 100_000), (2, None), (2, "same"), (2, "same")], "doc_id long, text string").withColumn("form", F.lit(1))
    assert quality.text_quality(df).count() == 4 and quality.text_quality(df.limit(0)).collect() == []


# ---- variety


def flow_cost(combos, taken, units):
    times, places = {}, {}
    for t, p, _, occasions in combos:
        times[t] = times.get(t, 0) + occasions
        places[p] = places.get(p, 0) + occasions
    total = 0.0
    for k, (sizes, at) in enumerate(((times, 0), (places, 1))):
        goal = variety.targets(sizes, units)
        for c in sizes:
            n = sum(x for x, row in zip(taken, combos) if row[at] == c)
            total += sum(variety._marginal(i, goal[c]) for i in range(1, n + 1))
    return total + sum(variety.REPEAT * max(0, x - row[3]) for x, row in zip(taken, combos))


def test_quotas_are_cheapest():
    r = random.Random(6)
    for _ in range(15):
        pairs = r.sample([(t, p) for t in "abc" for p in "xyz"], 5)
        combos = [(t, p, (o := r.randint(1, 3)) + r.randint(0, 2), o) for t, p in sorted(pairs)]
        units = r.randint(1, sum(c[2] for c in combos))
        got = variety.quotas(combos, units)
        assert sum(got) == units and all(0 <= x <= c[2] for x, c in zip(got, combos))
        best = min(flow_cost(combos, x, units) for x in itertools.product(*[range(c[2] + 1) for c in combos]) if sum(x) == units)
        assert flow_cost(combos, got, units) == pytest.approx(best, abs=1e-6)
    assert variety.quotas([], 5) == []


def test_varied_subset(spark):
    week = 7 * 86400.0
    crowd = [(i, "a", 1.5e9 + i * 0.5, 10.0, 10.0, False) for i in range(400)]
    rest = [(1000 + k, "a", 1.5e9 + week * (k // 3) + 7200 * k, 10.0 + k % 4, 10.0, k % 5 == 0) for k in range(60)]
    odd = [(2000, None, 1.0, 1.0, 1.0, True), (2001, "a", None, 1.0, 1.0, True), (2002, "b", 1.0, None, None, None), (2003, "b", 1.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(crowd + rest + odd, "photo_id long, person string, ts double, lat double, lon double, favorite boolean").withColumn("week", F.lit("clash"))
    got = variety.varied_subset(df, 20).collect()
    a = [x for x in got if x["person"] == "a"]
    assert len(a) == 20 and len({x["photo_id"] for x in a}) == 20 and sum(x["photo_id"] < 1000 for x in a) <= 4
    assert len({x["place"] for x in a}) == 4 and len({x["week"] for x in a}) >= 12
    assert sorted(x["photo_id"] for x in got if x["person"] == "b") == [2002, 2003]
    assert len(variety.varied_subset(df, 1000).where("person = 'a'").collect()) == 460
    assert variety.varied_subset(df.limit(0), 5).collect() == []
    assert {tuple(x) for x in variety.varied_subset(df.repartition(7), 20).collect()} == {tuple(x) for x in got}

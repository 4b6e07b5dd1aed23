"""Text garbled by a wrong character encoding: detection and repair by expectation-maximization.

Model. A clean text is a chain of characters; a latent encoding chain, with probabilities of its own for each table and
source, turned it into what is stored (mostly: nothing happened). Undoing a chain is a function, so each record has a few
candidate originals. The E step gives each candidate its posterior; the M step takes the character statistics and the
chain probabilities of each source from the posteriors of all records. Weak evidence in one record thus leans on what its
source and the language of all records show. Each record is then repaired by its posterior.

Distribution. Equal texts are counted first. Each step is one pass that ends in sums over the alphabet (character pairs).
Rounded likelihoods of equal shape are counted too; while they are few (SHAPES) the chain probabilities are worked out from
them on the driver, else in tasks that send sums by source and chain. So what reaches the driver is bounded by the alphabet,
the sources and SHAPES, not by rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeweave.session import checkpoint

#: Distinct (source, rounded likelihoods) that the driver takes; more are summed in tasks.
SHAPES = 200_000
#: The chain probabilities are settled when none moves by more than this.
SETTLED = 1e-4

IDENTITY = "none"
# Encodings for which UTF-8 is mistaken, and (true, assumed) pairs of single-byte encodings.
UTF8_AS = ["latin-1", "cp1252", "mac_roman", "cp1251", "cp850", "cp437", "cp1250", "koi8_r"]
BYTES_AS = [("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251")]
DOUBLE, STRIPPED, LOST = "utf-8 as cp1252 twice", "utf-8 as latin-1, controls dropped", "undecodable bytes replaced"

_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes that a codec leaves undefined stand for the control character of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


def _undo_utf8(codec: str):
    """A function that puts right every well-formed UTF-8 sequence shown in ``codec``; None if there is none."""
    table = _table(codec)
    of = lambda low, high: "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"
    tail = of(0x80, 0xBF)
    runs = re.compile(f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}})+")

    def right(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    def undo(text: str) -> str | None:
        new = runs.sub(right, text)
        return new if new != text else None

    return undo


def _undo_bytes(true: str, assumed: str):
    """A function that reads the non-ASCII characters as bytes of ``true`` shown in ``assumed``; None if one isn't any."""
    table = str.maketrans({c: bytes([b]).decode(true, "replace") for c, b in _table(assumed).items()})
    known = set(_table(assumed))

    def undo(text: str) -> str | None:
        if any(c > "\x7f" and c not in known for c in text):
            return None
        new = text.translate(table)
        return new if new != text and "�" not in new else None

    return undo


_UTF8 = {f"utf-8 as {c}": _undo_utf8(c) for c in UTF8_AS}
_BYTES = {f"{a} as {b}": _undo_bytes(a, b) for a, b in BYTES_AS}
_TWICE = _UTF8["utf-8 as cp1252"]

# Classes of characters: (first code point, name); each reaches up to the next. Those in WHOLE count as one symbol.
_BLOCKS = [
    (0x80, "control"), (0xA0, "latin-1 sign"), (0xC0, "latin-1"), (0x100, "latin extended"), (0x250, "phonetic"), (0x370, "greek"), (0x400, "cyrillic"), (0x460, "cyrillic rare"), (0x530, "other letters"), (0x1E00, "latin extended"), (0x2000, "punctuation"), (0x2070, "sign"),
    (0x2190, "sign"), (0x2500, "box"), (0x25A0, "picture"), (0x2E80, "cjk"), (0xA000, "other letters"), (0xE000, "private"), (0xF900, "cjk"), (0xFB00, "other letters"), (0xFE00, "picture"), (0xFE10, "other letters"), (0xFFFD, "lost"), (0xFFFE, "private"), (0x1F000, "picture"), (0x20000, "cjk"),
]
_WHOLE = {"cjk", "other letters", "picture", "private"}
#: Symbols that stand for a character of a class that was lost.
_LOST_CLASSES = {"upper": "latin-1 upper", "extended": "latin extended lower", "cyrillic": "cyrillic lower", "mark": "punctuation", "cjk": "cjk", "picture": "picture"}
WILD = {k: chr(0xE001 + i) for i, k in enumerate(_LOST_CLASSES)}
_WILD_CLASS = {WILD[k]: v for k, v in _LOST_CLASSES.items()}


_STANDS_FOR = {name: chr(0xF0000 + i) for i, name in enumerate(sorted(_WHOLE))}
_WILD_CLASS |= {c: name for name, c in _STANDS_FOR.items()}
_LOST_SYMBOLS = set(WILD.values())


@lru_cache(maxsize=65_536)
def symbol(c: str) -> tuple[str, str]:
    """(symbol, class) of a character: ASCII letters and digits by kind, large scripts as one symbol (of the private plane)."""
    if c in _WILD_CLASS:
        return c, _WILD_CLASS[c]
    if c < "\x80":
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "'" if c == "'" else "."
        return k, k
    name = next(n for low, n in reversed(_BLOCKS) if ord(c) >= low)
    if name in ("latin-1", "latin extended", "cyrillic", "greek"):
        name += " upper" if c.isupper() else " lower"
    return _STANDS_FOR.get(name, c), name


class _Symbols(dict):
    """Code point to symbol, for str.translate; worked out once for each character."""

    def __missing__(self, code: int) -> str:
        value = self[code] = symbol(chr(code))[0]
        return value


_SYMBOLS = _Symbols()


def pairs(text: str) -> Iterator[tuple[str, str]]:
    """Neighbouring symbols, with ends."""
    s = f"^{text.translate(_SYMBOLS)}$"
    return zip(s, s[1:])


class Characters:
    """Log probability of a text under counts of neighbouring symbols, backed off to classes."""

    BACKOFF, FLOOR = 20.0, 0.05

    def __init__(self, counts: dict[tuple[str, str], float]):
        self.pair = counts
        self.first: dict[str, float] = {}
        self.single: dict[str, float] = {}
        self.classes: dict[tuple[str, str], float] = {}
        self.class_first: dict[str, float] = {}
        self.class_size: dict[str, float] = {}
        for (p, c), n in counts.items():
            kp, kc = self._class(p), self._class(c)
            for d, k in ((self.first, p), (self.single, c), (self.classes, (kp, kc)), (self.class_first, kp), (self.class_size, kc)):
                d[k] = d.get(k, 0.0) + n
        self.known = _Steps(self.step)

    @staticmethod
    def _class(s: str) -> str:
        return symbol(s)[1] if s not in "^$" else s

    def step(self, p: str, c: str) -> float:
        kp, kc = self._class(p), self._class(c)
        by_class = (self.classes.get((kp, kc), 0.0) + self.FLOOR) / (self.class_first.get(kp, 0.0) + 40 * self.FLOOR)
        within = 1.0 if c in _LOST_SYMBOLS else (self.single.get(c, 0.0) + self.FLOOR) / (self.class_size.get(kc, 0.0) + 100 * self.FLOOR)
        if p in _LOST_SYMBOLS or c in _LOST_SYMBOLS:
            return math.log(by_class * within)
        return math.log((self.pair.get((p, c), 0.0) + self.BACKOFF * by_class * within) / (self.first.get(p, 0.0) + self.BACKOFF))

    def log_probability(self, text: str) -> float:
        return sum(map(self.known.__getitem__, pairs(text)))


class _Steps(dict):
    """Log probabilities of pairs, worked out once for each."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, pair: tuple[str, str]) -> float:
        value = self[pair] = self.of(*pair)
        return value


_LEFT = re.compile("Ã|[ÄÅÈ]|[ÐÑ]|â[\xa0-\xbf]?|ð[\xa0-\xbf]{0,3}|[ãåæçèéä](?=[¡-¿])[¡-¿]{1,2}")


def _wild(m: re.Match) -> str:
    c = m[0][0]
    return WILD["upper" if c == "Ã" else "extended" if c in "ÄÅÈ" else "cyrillic" if c in "ÐÑ" else "mark" if c == "â" else "picture" if c == "ð" else "cjk"]


def candidates(text: str) -> list[tuple[str, str]]:
    """(chain, original) of every chain that could have led to ``text``, the identity first. Long texts are taken whole."""
    out = [(IDENTITY, text)]
    if not _NON_ASCII.search(text):
        return out
    if "�" in text:
        out.append((LOST, re.sub("�+", WILD["mark"], text)))
    for name, undo in _UTF8.items():
        new = undo(text)
        if new is not None:
            out.append((name, new))
            if undo is _TWICE and (again := undo(new) or _UTF8["utf-8 as latin-1"](new)) is not None:
                out.append((DOUBLE, again))
    for name, undo in _BYTES.items():
        new = undo(text)
        if new is not None:
            out.append((name, new))
    mended = _UTF8["utf-8 as latin-1"](text) or text
    stripped = _LEFT.sub(_wild, mended)
    if stripped != mended:
        out.append((STRIPPED, stripped))
    return out


def _plain(found: list[tuple[str, str]]) -> bool:
    """Whether the first character statistics may count a text as it stands: it holds no sign of a misread encoding."""
    text = found[0][1]
    return not any(c.startswith("utf-8") and c != STRIPPED or c == LOST for c, _ in found[1:]) and not re.search("[À-ÖØ-öø-ÿ]{3}", text)


_CHAINS = [IDENTITY, *_UTF8, DOUBLE, *_BYTES, STRIPPED, LOST]
_START = {c: 0.9 if c == IDENTITY else 0.1 / (len(_CHAINS) - 1) for c in _CHAINS}


def posterior(found: list[tuple[str, str]], model: Characters, prior: dict[str, float]) -> list[float]:
    if len(found) == 1:
        return [1.0]
    logs = [math.log(prior.get(c, 1e-9) + 1e-9) + model.log_probability(y) for c, y in found]
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    total = sum(weights)
    return [w / total for w in weights]


def _sum_pairs(texts: DataFrame, weigh) -> dict[tuple[str, str], float]:
    """Counts of neighbouring symbols over all texts. ``weigh`` gives [(text, weight)] of a row's text and group."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], float] = {}
        for pdf in batches:
            for text, group, n in zip(pdf["text"], pdf["grp"], pdf["n"]):
                for y, w in weigh(text, group):
                    w *= n
                    if w > 1e-6:
                        for pair, k in Counter(pairs(y)).items():
                            total[pair] = total.get(pair, 0.0) + w * k
        if total:
            yield pd.DataFrame({"p": [p for p, _ in total], "c": [c for _, c in total], "w": list(total.values())})

    rows = texts.mapInPandas(count, "p string, c string, w double").groupBy("p", "c").agg(F.sum("w").alias("w")).collect()
    return {(r["p"], r["c"]): r["w"] for r in rows}


def _options(shape: str) -> list[tuple[str, int]]:
    return [(_CHAINS[int(i)], int(v)) for i, _, v in (x.partition(":") for x in shape.split(";") if x)]


def _expected(rows: Iterable[tuple[str, str, float]], priors: dict[str, dict[str, float]]) -> dict[tuple[str, str], float]:
    """E step: how many records of each group each chain is expected to explain. ``rows``: group, shape, records."""
    seen: dict[tuple[str, str], float] = {}
    for group, shape, n in rows:
        prior = priors.get(group, _START)
        weights = [(IDENTITY, prior[IDENTITY])] + [(c, prior[c] * math.exp(v)) for c, v in _options(shape)]
        total = sum(w for _, w in weights)
        for c, w in weights:
            seen[(group, c)] = seen.get((group, c), 0.0) + n * w / total
    return seen


def _priors(texts: DataFrame, model: Characters, rounds: int, most: int = SHAPES) -> dict[str, dict[str, float]]:
    """Chain probabilities of each group, by EM over the likelihoods of all records, rounded to whole nats and counted."""

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], float] = {}
        for pdf in batches:
            for text, group, n in zip(pdf["text"], pdf["grp"], pdf["n"]):
                found = candidates(text)
                base = model.log_probability(text) if len(found) > 1 else 0.0
                shape = ";".join(f"{_CHAINS.index(c)}:{max(-25, min(25, round(model.log_probability(y) - base)))}" for c, y in found[1:])
                total[(group, shape)] = total.get((group, shape), 0.0) + n
        if total:
            yield pd.DataFrame({"grp": [g for g, _ in total], "shape": [s for _, s in total], "n": list(total.values())})

    shapes = checkpoint(texts.mapInPandas(rate, "grp string, shape string, n double").groupBy("grp", "shape").agg(F.sum("n").alias("n")))
    few = shapes.limit(most + 1).collect()
    rows = [tuple(r) for r in few] if len(few) <= most else None
    out: dict[str, dict[str, float]] = {}
    for _ in range(rounds):
        if rows is not None:
            seen = _expected(rows, out)
        else:

            def partly(batches: Iterator[pd.DataFrame], priors: dict = out) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    sums = _expected(zip(pdf["grp"], pdf["shape"], pdf["n"]), priors)
                    yield pd.DataFrame({"grp": [g for g, _ in sums], "chain": [c for _, c in sums], "n": list(sums.values())})

            sums = shapes.mapInPandas(partly, "grp string, chain string, n double").groupBy("grp", "chain").agg(F.sum("n").alias("n"))
            seen = {(r["grp"], r["chain"]): r["n"] for r in sums.collect()}
        new: dict[str, dict[str, float]] = {}
        for group in {g for g, _ in seen}:
            counts = {c: 0.1 + seen.get((group, c), 0.0) for c in _CHAINS}
            size = sum(counts.values())
            new[group] = {c: v / size for c, v in counts.items()}
        moved = max((abs(p - out.get(g, _START)[c]) for g, prior in new.items() for c, p in prior.items()), default=0.0)
        out = new
        if moved < SETTLED:
            break
    return out


def fit(texts: DataFrame, steps: int = 2, rounds: int = 25) -> tuple[dict[tuple[str, str], float], dict[str, dict[str, float]]]:
    """Character counts and chain probabilities, from ``texts`` (grp: source and field; text; n: how often)."""
    counts = _sum_pairs(texts, lambda text, _: [(text, 1.0)] if _plain(candidates(text)) else [])
    priors: dict[str, dict[str, float]] = {}
    for step in range(steps):
        model = Characters(counts)
        priors = _priors(texts, model, rounds)
        if step == steps - 1:
            break

        def weigh(text: str, group: str, model: Characters = model, priors: dict = priors) -> list[tuple[str, float]]:
            found = candidates(text)
            return list(zip([y for _, y in found], posterior(found, model, priors.get(group, _START))))

        counts = _sum_pairs(texts, weigh)
    return counts, priors


def repair(rows: DataFrame, sure: float = 0.5) -> DataFrame:
    """Garbled rows: tbl, row_id, chain (the likeliest), posterior (of any chain but the identity), restored (the text put
    right; NULL where characters are lost for good).

    ``rows`` has tbl, row_id, source, text; all of them shape the statistics, none is sampled. Null and empty texts are
    never garbled; equal texts of one source get the same result; an empty table gives no rows."""
    rows = rows.select("tbl", "row_id", F.concat_ws("\n", "tbl", F.coalesce("source", F.lit(""))).alias("grp"), "text").where(F.col("text") != "")
    texts = checkpoint(rows.groupBy("grp", "text").agg(F.count("*").cast("double").alias("n")))
    counts, priors = fit(texts)
    limit = float(sure)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Characters(counts)

        def judge(group: str, text: str) -> tuple[str, float, str | None] | None:
            found = candidates(text)
            if len(found) == 1:
                return None
            post = posterior(found, model, priors.get(group, _START))
            if 1 - post[0] <= limit:
                return None
            k = max(range(1, len(found)), key=post.__getitem__)
            whole = found[k][0] not in (LOST, STRIPPED)
            return found[k][0], 1 - post[0], found[k][1] if whole else None

        short = lru_cache(maxsize=50_000)(judge)
        for pdf in batches:
            got = [(short if len(t) < 500 else judge)(g, t) for g, t in zip(pdf["grp"], pdf["text"])]
            hit = [i for i, x in enumerate(got) if x is not None]
            if hit:
                part = pdf.iloc[hit]
                yield pd.DataFrame({"tbl": part["tbl"].to_numpy(), "row_id": part["row_id"].to_numpy(), "chain": [got[i][0] for i in hit], "posterior": [got[i][1] for i in hit], "restored": [got[i][2] for i in hit]})

    odd = rows.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return odd.mapInPandas(mend, "tbl string, row_id bigint, chain string, posterior double, restored string")

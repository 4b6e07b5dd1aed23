"""Text statistics of documents, and prose told from lists, tables and junk by combined rules.

Everything is computed per document in Arrow batches: one pass, no shuffle, whole texts. Repetition statistics (duplicate
lines and paragraphs, the share of the text that its dominant word n-grams of several lengths cover) complete the surface
statistics. Each line is judged by its own form, and the document by combined rules: how much of its text lies in lines of
each form, in boilerplate and in repetition. Words are counted for many texts at once, in arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Frequent function words, by language. Their share tells running text from lists of names and things.
FUNCTION_WORDS = {
    "en": "the of and to a in that it is was for on as with his they at be this from i have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has her two like him see could no make than been its who now my over did down only way find may after most our before because while until",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir ich mir mich uns unser mein meine kein keine hatte waren wenn ihr weil dann schon dort hier später erst",
    "fr": "le la les de des du et à en un une que qui dans pour pas sur au aux avec ce il elle sont ne se par plus est son sa ses nous vous ils on mais ou où était été fait être avoir ont cette ces comme tout très leur y d l c qu n s j m nos notre mon ma mes alors sans",
    "es": "el la los las de del y a en un una que por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes era fue había mi tan así",
    "pt": "o a os as de do da dos das e em um uma que por com para não se no na ao mais como mas foi ele ela seu sua ou ser quando muito há nos já está eu também só pelo pela até isso",
    "it": "il lo la i gli le di del della e a in un una che per con non si da al come più ma anche sono era ha questo nel alla mi ci se o dei delle",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over ze hij wij ik was naar heeft deze",
    "pl": "i w na z do nie się to że jest o jak a po co tak za od ale przez przy już tylko dla był była było są czy jej jego",
    "ru": "и в не на я что с по это как а но он она мы они к у из за так же от бы было был была для о до или мне нас ты уже если когда",
}

_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BULLET = re.compile(r"^\s*(?:[-*•‣◦▪·–—+]|\[[ xX✓]?\]|[☐☑✓✔]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\d{1,2}:\d{2}(?::\d{2})?)\s+\S")
# Marks that end a sentence, and what may close after them.
TERMINAL, CLOSING = ".!?…。！？", "\"'”’»)]"
# Phrases of pages' frames. A text most of which lies in lines that hold one is boilerplate.
BOILERPLATE = [
    "accept cookies", "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "cookie settings", "follow us on", "log in to", "privacy policy", "read more", "share this", "sign up for", "skip to content", "subscribe to our",
    "terms of service", "terms of use", "unsubscribe", "we use cookies", "your newsletter",
]
_SEMICOLON, _COMMA, _CELL = re.compile(r";(?=\S)"), re.compile(r",(?=\S)"), re.compile(r"</?t[rdh]\b")
_COLUMNS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_BREAK = re.compile(r"\n\s*\n")
_PAIRS = re.compile(r"(?<![\w=])[\w.:-]+=[^\s=]")
_DIGITS = re.compile(r"\d+")
_BEYOND_LATIN = re.compile(r"[\u0250-\U0010ffff]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_VOWELS = re.compile(r"[aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœýÿąęăăîâаеёиоуыэюяіїєα-ω]", re.IGNORECASE)

_NO_VOWEL, _MIXED = re.compile(r"[bcdfghjklmnpqrstvwxz]{6}", re.IGNORECASE), re.compile(r"[a-z][A-Z]")

#: A text is junk if its dominant n-gram covers more than DOMINANT of it (of a short text, more than the words that GRAMS
#: gives for n, so that a turn of phrase used twice is none), or if more than REPEATED of it are paragraphs that occurred before.
DOMINANT, REPEATED = 0.3, 0.5
GRAMS = {2: 10, 3: 10, 4: 10, 8: 32}
#: Texts are described so many characters at a time; a longer text alone.
SLICE_CHARS = 2_000_000

STATISTICS = {
    "n_chars": "bigint", "n_words": "bigint", "n_lines": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "end_punctuation_ratio": "double", "common_word_ratio": "double",
    "duplicate_line_ratio": "double", "duplicate_paragraph_ratio": "double", "top_2gram_ratio": "double", "top_3gram_ratio": "double", "top_4gram_ratio": "double", "top_8gram_ratio": "double", "boilerplate_ratio": "double", "list_ratio": "double", "table_ratio": "double", "junk_ratio": "double",
}

_COMMON = {w for text in FUNCTION_WORDS.values() for w in text.split()}


def _repeated(parts: list[str]) -> float:
    """Share of the characters that lies in parts that occurred before."""
    seen: set[str] = set()
    total = again = 0
    for p in parts:
        p = p.strip()
        if not p:
            continue
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _pronounceable(word: str) -> bool:
    """Whether a word could be one: some vowel in it, no long run without, no digits or capitals inside."""
    return len(word) < 4 or not word.isascii() or bool(_VOWELS.search(word)) and not _NO_VOWEL.search(word) and not _MIXED.search(word, 1)


class _Words(dict):
    """Numbers of words, and what is known of each: characters, letters, whether it is a function word, its letters if it is
    unpronounceable, and a random number of its lower-case form."""

    MOST = 300_000

    def __init__(self):
        super().__init__()
        self.rows: list[tuple] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.rows)
        low = word.lower()
        letters = len(word) - word.count("'") - word.count("’")
        self.rows.append((len(word), letters, low in _COMMON, 0 if _pronounceable(word) else len(word), int.from_bytes(blake2b(low.encode(), digest_size=7).digest())))
        return k

    def look_up(self, words: list[str]) -> np.ndarray:
        """A row for each of ``words``."""
        if len(self) > self.MOST:
            self.clear()
            self.rows = []
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.array(self.rows, dtype=np.int64).reshape(-1, 5)[at]


_WORDS_SEEN = _Words()


def _dominant(doc: np.ndarray, code: np.ndarray, size: np.ndarray, docs: int) -> dict[int, np.ndarray]:
    """For each of GRAMS and each text, the characters that the occurrences of its most frequent n-gram cover, if it occurs
    twice; of equally frequent ones that which covers most. Words: text, number and characters, in order."""
    out = {n: np.zeros(docs) for n in GRAMS}
    total = np.concatenate([[0], np.cumsum(size)])
    hashed = code.astype(np.uint64)
    starts = np.arange(len(code))
    for n in GRAMS:
        # only where a repeated shorter n-gram begins, and one ends, can a longer one be repeated
        starts = starts[starts + n <= len(code)]
        starts = starts[doc[starts] == doc[starts + n - 1]]
        if not len(starts):
            break
        h = np.zeros(len(starts), dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashed[starts + i]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[starts].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
        times = np.diff(np.append(first, len(order)))
        again = times > 1
        at, k = starts[order[first[again]]], times[again]
        chars = total[at + n] - total[at]
        best = np.zeros(docs, dtype=np.int64)
        np.maximum.at(best, doc[at], (k << 32) + chars)
        out[n] = (best >> 32) * (best & 0xFFFFFFFF)
        starts = np.sort(starts[order[np.repeat(again, times)]])
    return out


def _ends_a_sentence(line: str) -> bool:
    return line.rstrip().rstrip(CLOSING)[-1:] in TERMINAL if line.strip() else False


def line_form(line: str, words: int, letters: int, common: int, odd: int) -> str:
    """'list', 'table', 'junk' or 'text'. Of the line's words: how many, their characters, how many are function words, and
    the characters of unpronounceable ones."""
    s = line.strip()
    tokens = s.split()
    solid, longest = sum(map(len, tokens)), max(map(len, tokens), default=0)
    if not s.isascii() and letters > 0.5 * solid and _CJK.search(s):
        return "list" if _BULLET.match(line) else "text"
    if _BULLET.match(line):
        return "list"
    running = common >= 0.3 * words and words >= 5
    if s.count("<") >= 4 and len(_CELL.findall(s)) >= 4:
        return "table"
    if not running:
        gaps = len(_COLUMNS.findall(s)) if "  " in s or "\t" in s else 0
        commas = s.count(",")
        cells = max(gaps, s.count("|"), len(_SEMICOLON.findall(s)) if ";" in s else 0, len(_COMMA.findall(s)) if commas else 0)
        if "\t" in s and cells or cells >= 2 or gaps and letters < 0.7 * solid:
            return "table"
        keyed = len(_PAIRS.findall(s)) if "=" in s else 0
        if keyed >= 2:
            return "table"
        if keyed and re.match(r"[\[(]?[\d:.T-]+", s):
            return "junk"  # a line of a log
        if commas >= 3 and len(tokens) / (commas + 1) <= 4.5 and not _ends_a_sentence(s):
            return "list"
    if solid and letters < 0.5 * solid:
        return "junk"
    if odd > 0.4 * max(letters, 1) or longest > 40 and letters > 0 and longest > 0.5 * solid:
        return "junk"
    return "text"


def describe(texts: Sequence[str | None]) -> list[tuple]:
    """The values of STATISTICS of each text, in order; a null text counts as empty."""
    texts = [t or "" for t in texts]
    lines: list[str] = []
    words: list[str] = []
    line_of, word_of = [0], [0]
    for t in texts:
        for x in t.splitlines():
            if x.strip():
                lines.append(x)
                words += _WORDS.findall(x)
                word_of.append(len(words))
        line_of.append(len(lines))
    known = _WORDS_SEEN.look_up(words)
    sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(known[:, :4], axis=0)])
    in_line = np.diff(sums[word_of], axis=0).tolist()
    per_line = np.diff(word_of).tolist()
    ends = np.array(word_of)[line_of]
    in_text, per_text = np.diff(sums[ends], axis=0).tolist(), np.diff(ends).tolist()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    top = {n: v.tolist() for n, v in _dominant(doc, known[:, 4], known[:, 0], len(texts)).items()}
    out = []
    for i, text in enumerate(texts):
        mine = lines[line_of[i] : line_of[i + 1]]
        solid = len("".join(text.split()))
        digits = sum(map(text.count, "0123456789")) if text.isascii() else len(text) - len(_DIGITS.sub("", text))
        chars, letters, common, _ = in_text[i]
        low = text.lower()
        framed = [k for k in BOILERPLATE if k in low]
        forms, frame = {"list": 0, "table": 0, "junk": 0, "text": 0}, 0
        for j, x in enumerate(mine, line_of[i]):
            size = len(x.strip())
            c, _, known_words, odd = in_line[j]
            forms[line_form(x, per_line[j], c, known_words, odd)] += size
            if framed and any(k in x.lower() for k in framed):
                frame += size
        size, n = sum(forms.values()) or 1, per_text[i]
        out.append((
            len(text), n, len(mine), chars / n if n else 0.0, (solid - letters - digits) / solid if solid else 0.0, digits / solid if solid else 0.0,
            sum(map(_ends_a_sentence, mine)) / len(mine) if mine else 0.0, common / n if n else 0.0,
            _repeated(mine) if len(mine) > 1 else 0.0, _repeated(_BREAK.split(text)) if len(mine) > 1 else 0.0, *[min(1.0, top[g][i] / chars) if n >= 2 * g else 0.0 for g in GRAMS], frame / size, forms["list"] / size, forms["table"] / size, forms["junk"] / size,
        ))
    return out


def judge(text: str | None, stats: tuple) -> str:
    """'prose', 'list', 'table', 'boilerplate', 'junk' or 'empty'."""
    v = dict(zip(STATISTICS, stats))
    text = text or ""
    if v["n_words"] == 0:
        return "empty" if not text.strip() else "junk"
    shares = {k: v[f"{k}_ratio"] for k in ("list", "table", "junk")}
    if sum(shares.values()) > 0.5:
        return max(shares, key=shares.get)
    if any(v[f"top_{n}gram_ratio"] > max(DOMINANT, least / v["n_words"]) for n, least in GRAMS.items()) or v["duplicate_paragraph_ratio"] > REPEATED:
        return "junk"
    if v["boilerplate_ratio"] > 0.5:
        return "boilerplate"
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    if cjk > 0.3 * len(text):
        return "prose"
    # what is left looks like words in lines: prose holds function words, lists of things don't
    if v["duplicate_line_ratio"] > 0.8 and v["n_lines"] >= 5:
        return "junk"
    short = v["n_words"] / max(1, v["n_lines"])
    if v["common_word_ratio"] < 0.15:
        latin = 1 - len(_BEYOND_LATIN.findall(text)) / max(1, len(text))
        sentences = len(re.findall(r"[^\W\d_]{2,}[.!?…](?:\s|$)", text))
        # an unknown language: sentences of a plausible length, words of varied length, little repetition
        if latin < 0.5 and short >= 4 or sentences >= 1 and 4 <= v["n_words"] / sentences <= 40 and v["n_words"] >= 4 and v["common_word_ratio"] >= 0.05 or v["n_words"] < 12 and sentences and short >= 4:
            return "prose"
        return "junk" if v["common_word_ratio"] < 0.05 else "list"
    if short < 4 and v["end_punctuation_ratio"] < 0.5 and v["n_lines"] >= 3:
        return "list"
    return "prose"


def text_quality(documents: DataFrame) -> DataFrame:
    """doc_id, the columns of STATISTICS and form ('prose', 'list', 'table', 'boilerplate', 'junk', 'empty') of every document.

    A null text counts as empty; each row is judged on its own, so repeated texts get equal results; texts of any length
    are taken whole; an empty table gives no rows."""
    names = list(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            stats, texts, at, size = [], pdf["text"].tolist(), 0, 0
            for k, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= SLICE_CHARS or k == len(texts):
                    stats += describe(texts[at:k])
                    at, size = k, 0
            out = pd.DataFrame(stats, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out["form"] = [judge(t, s) for t, s in zip(texts, stats)]
            yield out

    schema = "doc_id bigint, " + ", ".join(f"{k} {t}" for k, t in STATISTICS.items()) + ", form string"
    return documents.select("doc_id", "text").mapInPandas(run, schema)

"""Evaluation texts that leak into documents, by Wu-Manber multi-pattern search.

Method. Texts are folded to their letters and digits, so that case, punctuation, spacing, line breaks, hyphenation, quote
marks and markup make no difference. The patterns are the folded strings of fixed length at each word of the test items (at
each character in scripts without spaces, where every character counts as a word). A table of block shifts skips positions
at which no pattern can end, buckets by the suffix block select the patterns that may, and direct comparison confirms them.
Each confirmed place is then widened to the longest equal run of characters, runs of one item are joined across changed
words, and the best passage is measured.

Distribution. Items of equal words are searched as one and joined to all their ids afterwards. Which words an item shares
with others is settled over the whole item table, before the search. The items then go to the tasks in passes of at most
PASS_CHARS characters (a longer item is a pass of its own), so what is broadcast is bounded whatever the table's size, and no
result depends on the cut: each item is searched and measured on its own. A worker builds a pass's tables once. Documents
are read whole, once a pass, and never shuffled; equal texts in a batch are searched once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeweave.session import checkpoint

#: Folded characters of the items of one pass over the documents.
PASS_CHARS = 4_000_000
#: Length of patterns and of the blocks of the shift table: in scripts with spaces, and in those where a character is a word.
LENGTH, BLOCK = 20, 6
LENGTH_DENSE, BLOCK_DENSE = 8, 3
#: Words in a run of SHARED_WORDS that an item of another text has too are shared.
SHARED_WORDS = 7

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_DROP = re.compile(r"[\W_]+")
# Scripts written without spaces between words (kana, Han, Thai, Lao, Burmese, Khmer).
_DENSE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff"
_WORD = re.compile(f"(?=[^\\W_])[{_DENSE}]|(?:(?![{_DENSE}])[^\\W_])+")
_SPACED_WORD = re.compile(r"[^\W_]+")
_DENSE_LETTER = re.compile(f"[{_DENSE}]")


def plain(text: str) -> str:
    """A text without markup and entities, in one case and one Unicode form."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.casefold()


def folded(text: str) -> str:
    return _DROP.sub("", plain(text))


def words_of(text: str) -> list[str]:
    """The words of an item; a character of a script without spaces is a word."""
    text = plain(text)
    return _WORD.findall(text) if _DENSE_LETTER.search(text) else _SPACED_WORD.findall(text)


class Item:
    """The words of one or more test items: their folded form, where words begin and end in it, and which are its own."""

    def __init__(self, key: int, words: list[str], shared: list[int] | None = None):
        self.key, self.words = key, words
        self.text = "".join(words)
        self.begin, self.end, at = [], [], 0
        for w in words:
            self.begin.append(at)
            at += len(w)
            self.end.append(at)
        # runs of SHARED_WORDS words that begin at ``shared`` are not its own, unless that leaves nothing
        self.own = [True] * len(words)
        for i in shared or ():
            self.own[i : i + SHARED_WORDS] = [False] * SHARED_WORDS
        if not any(self.own):
            self.own = [True] * len(words)
        self.dense = 2 * len(_DENSE_LETTER.findall(self.text)) > len(self.text)


class Patterns:
    """Shift table and suffix buckets over the items' patterns of one length."""

    def __init__(self, items: list[Item], length: int = LENGTH, block: int = BLOCK):
        self.items, self.length, self.block = items, length, block
        self.where: dict[str, list[tuple[int, int]]] = {}
        for n, it in enumerate(items):
            for at in it.begin:
                if at + length <= len(it.text):
                    self.where.setdefault(it.text[at : at + length], []).append((n, at))
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, set[str]] = {}
        for p in self.where:
            for k in range(length - block + 1):
                b, s = p[k : k + block], length - block - k
                if s < self.shift.get(b, length):
                    self.shift[b] = s
            self.buckets.setdefault(p[-block:], set()).add(p)

    def occurrences(self, text: str) -> Iterator[tuple[int, str]]:
        """(position, pattern) of every pattern in a folded text."""
        length, block = self.length, self.block
        shift, buckets, most, n, at = self.shift, self.buckets, length - block + 1, len(text), length
        get = shift.get
        while at <= n:
            s = get(text[at - block : at], most)
            if s:
                at += s
                continue
            found = text[at - length : at]
            if found in buckets[text[at - block : at]]:
                yield at - length, found
            at += 1

    def passages(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """For each item with a seed in a folded text, its best passage: words spanned, of them changed, own words held,
        and own words of the item. The best spans most words with at most one changed word in ten."""
        runs: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for p, found in self.occurrences(text):
            for n, j in self.where[found]:
                by = runs.setdefault(n, {}).setdefault(p - j, [])
                if by and by[-1][0] <= p and p + self.length <= by[-1][0] + by[-1][2]:
                    continue  # inside a run already widened
                it = self.items[n].text
                a, b = p, p + self.length
                while a > 0 and a - p + j > 0 and text[a - 1] == it[a - 1 - p + j]:
                    a -= 1
                while b < len(text) and b - p + j < len(it) and text[b] == it[b - p + j]:
                    b += 1
                by.append((a, a - p + j, b - a))
        return {self.items[n].key: best for n, by in runs.items() if (best := self._best(self.items[n], [r for rs in by.values() for r in rs])) is not None}

    @staticmethod
    def _best(it: Item, runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | None:
        spans = []
        for p, j, length in runs:
            first, last = bisect_left(it.begin, j), bisect_right(it.end, j + length)  # whole words [first, last)
            if last > first:
                spans.append((first, last, p + it.begin[first] - j, p + it.end[last - 1] - j))
        spans.sort(key=lambda s: (s[2], s[0]))
        # chains of runs in the order of both texts; between them words of the item may be changed, not left out or added. A
        # run can take in the first or last letters of a changed word that happen to be a word of the item ('a' of 'almost'):
        # then the runs meet in the item but not in the text, and one word was changed after all
        best: tuple | None = None
        chains: list[list[tuple[int, int, int, int]]] = []
        for s in spans:
            into = None
            for c in chains:
                _, l, _, e = c[-1]
                gap, apart = s[0] - l, s[2] - e
                if -1 <= gap <= max(3, (l - c[0][0]) // 5) and apart >= -2 and apart <= 16 * max(gap, 1) + 2 and (into is None or c[-1][1] > into[-1][1]):
                    into = c
            if into is None:
                chains.append([s])
            else:
                into.append(s)
        total = sum(it.own)
        for c in chains:
            for a in range(len(c)):
                held = own = 0
                for b in range(a, len(c)):
                    first = c[b][0] if b == a else max(c[b][0], c[b - 1][1])
                    met = b > a and c[b][0] <= c[b - 1][1] and c[b][2] != c[b - 1][3]
                    held += c[b][1] - first - met
                    own += sum(it.own[first : c[b][1]]) - met
                    words = c[b][1] - c[a][0]
                    changed = words - held
                    if changed * 10 <= words and (best is None or words > best[0]):
                        best = (words, changed, own, total)
        return best


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words, text (the words in one string) of every item that holds a word, written once."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [words_of(t) for t in pdf["text"]]})

    split_items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().mapInPandas(split, "item_id bigint, words array<string>")
    return checkpoint(split_items.where("size(words) > 0").withColumn("text", F.array_join("words", " ")))


def _searched(known: DataFrame) -> DataFrame:
    """rep (smallest id of the items of equal words), words and shared (where runs of SHARED_WORDS words begin that an item of
    other words has too), over the whole item table."""
    alike = known.groupBy("text").agg(F.min("item_id").alias("rep")).select("rep", F.split("text", " ").alias("words"))
    starts = F.when(F.size("words") >= SHARED_WORDS, F.sequence(F.lit(0), F.size("words") - SHARED_WORDS))
    runs = alike.select("rep", F.explode(starts).alias("at"), "words").select("rep", "at", F.array_join(F.slice("words", F.col("at") + 1, SHARED_WORDS), " ").alias("run"))
    # a run of several items: the smallest and the largest of them differ
    common = runs.groupBy("run").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("run")
    shared = runs.join(common, "run", "left_semi").groupBy("rep").agg(F.collect_list("at").alias("shared"))
    return alike.join(shared, "rep", "left")


#: Search tables of the latest passes, kept between the tasks of a Python worker.
_TABLES: dict[str, list[Patterns]] = {}


def _tables(token: str, shared) -> list[Patterns]:
    if token not in _TABLES:
        while len(_TABLES) >= 2:
            _TABLES.pop(next(iter(_TABLES)))
        items = [Item(*x) for x in shared.value]
        sets = ((False, LENGTH, BLOCK), (True, LENGTH_DENSE, BLOCK_DENSE))
        _TABLES[token] = [Patterns(mine, n, b) for dense, n, b in sets if (mine := [it for it in items if it.dense == dense])]
    return _TABLES[token]


def _passes(searched: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items in passes of at most ``most`` folded characters, read one after the other."""
    part: list[tuple] = []
    size = 0
    for r in searched.toLocalIterator():
        n = sum(map(len, r["words"]))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((r["rep"], r["words"], r["shared"]))
        size += n
    if part:
        yield part


def find_passages(documents: DataFrame, items: DataFrame, pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id, item_id, words (spanned by the best passage), changed, own (words held that are the item's own), item_words,
    item_own for every pair of a document and an item of which it holds at least one pattern.

    Null, empty and very short texts (fewer letters than a pattern) hold nothing; equal documents get equal results, one row
    for each document and item; equal items are found under each of their ids; an empty table on either side gives no rows."""
    spark = documents.sparkSession
    known = item_words(items)
    read = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    columns = ["doc_id", "rep", "words", "changed", "own", "item_words", "item_own"]
    schema = ", ".join(f"{c} bigint" for c in columns)
    out = None
    for part in _passes(_searched(known), pass_chars):
        shared, token = spark.sparkContext.broadcast(part), uuid.uuid4().hex
        sizes = {k: len(w) for k, w, _ in part}

        def search(batches: Iterator[pd.DataFrame], shared=shared, token=token, sizes=sizes) -> Iterator[pd.DataFrame]:
            tables = _tables(token, shared)

            @lru_cache(maxsize=256)
            def one(text: str) -> dict:
                text = folded(text)
                return {k: v for t in tables for k, v in t.passages(text).items()}

            for pdf in batches:
                got = [(d, i, w, c, o, sizes[i], t) for d, text in zip(pdf["doc_id"], pdf["text"]) for i, (w, c, o, t) in one(text).items()]
                if got:
                    yield pd.DataFrame(got, columns=columns)

        found = read.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    reps = known.join(known.groupBy("text").agg(F.min("item_id").alias("rep")), "text").select("item_id", "rep")
    return out.join(reps, "rep").select("doc_id", "item_id", *columns[2:])


def leaks(documents: DataFrame, items: DataFrame, share: float = 1 / 3, quotation: int = 12, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Pairs of ``find_passages`` that are leaks: the passage spans at least ``share`` of the item's words and more than a
    short quotation (at least ``quotation`` words, the whole of a shorter item, or words most of which are the item's own), at
    most one in ten of them changed, and as large a share of the words that are the item's own, which shared instructions aren't."""
    found = find_passages(documents, items, pass_chars)
    return found.where(f"words >= {share!r} * item_words AND (words >= least({int(quotation)}, item_words) OR 2 * own > words) AND own >= {0.9 * share!r} * item_own AND own > 0")

"""Toxicity scores from a learned lexicon, misspelling-tolerant lookup and the words around each hit.

Terms come from labelled documents: whole words and word beginnings that toxic documents hold far more often than clean ones. They
lie in a trie; a word's Levenshtein automaton, run over the trie, finds terms within one edit (two for long words). Each hit's window
decides how much of it counts as abuse and how much as quotation. A logistic model over the hits gives the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_](?:[\w*@$!'’-]*[^\W_])?")
#: Characters that stand for letters in disguised words.
SWAPS = str.maketrans("@$013457!", "asoleasti")
QUOTES = re.compile("[\"“”„«»]")
#: Words that report or discuss a word rather than hurl it.
REPORTING = frozenset("said says say called calls quote quoted quotes wrote word words term terms slur insult insults meaning means example definition reported allegedly".split())
ADDRESS = frozenset("you your you're youre u ur yourself".split())
STEMS = (4, 5, 6)
WINDOW = 48


@dataclass
class Trie:
    """Nested dicts; key '' holds a term's kind: 'word' ends there, 'stem' accepts any ending."""

    root: dict = field(default_factory=dict)

    def add(self, term: str, kind: str) -> None:
        at = self.root
        for ch in term:
            at = at.setdefault(ch, {})
        at[""] = kind

    def exact(self, word: str) -> bool:
        at = self.root
        for ch in word:
            if at.get("") == "stem":
                return True
            at = at.get(ch)
            if at is None:
                return False
        return "" in at


def _codes(words: list[str], n: int) -> np.ndarray:
    """Code points of words of n letters, one row a word."""
    return np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Bit sets of the letters of each row, and above them of those that occur twice."""
    once = twice = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        bit = np.uint64(1) << (column & np.uint64(31))
        once, twice = once | bit, twice | (once & bit)
    return once | twice << np.uint64(32)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Bit sets of the pairs of neighbours of each row."""
    bits = np.uint64(1) << ((codes[:, :-1] * np.uint64(37) + codes[:, 1:]) & np.uint64(63))
    return np.bitwise_or.reduce(bits, axis=1)


class Lexicon:
    """Whole-word terms in a trie; a node knows the range of the sorted terms below it."""

    #: Letters at a word's either end whose partners lie at the same end.
    END = 4
    ROWS = 2048

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.near: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        self.root = self._node(0, len(self.terms), 0)

    def _node(self, low: int, high: int, depth: int) -> tuple[int, int, bool, dict]:
        ends = low < high and len(self.terms[low]) == depth
        to, at = {}, low + ends
        while at < high:
            ch, start = self.terms[at][depth], at
            while at < high and self.terms[at][depth] == ch:
                at += 1
            to[ch] = self._node(start, at, depth + 1)
        return low, high, ends, to

    def _marks(self, codes: np.ndarray, edits: int) -> np.ndarray:
        """A row for each kind of bit set: letters, pairs, and letters of the ends, narrow and wide."""
        narrow, wide = self.END, self.END + edits
        ends = (codes[:, :narrow], codes[:, :wide], codes[:, -narrow:], codes[:, -wide:])
        return np.stack([_letters(codes), _pairs(codes), *map(_letters, ends)])

    def _terms_near(self, n: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and marks of the terms whose length an edited word of n letters can have."""
        got = self.near.get((n, edits))
        if got is None:
            at, marks = [np.zeros(0, np.int64)], [np.zeros((6, 0), np.uint64)]
            for size in range(max(2, n - edits), n + edits + 1):
                some = [i for i, t in enumerate(self.terms) if len(t) == size]
                if some:
                    at.append(np.array(some))
                    marks.append(self._marks(_codes([self.terms[i] for i in some], size), edits))
            order = np.argsort(np.concatenate(at), kind="stable")
            got = self.near[n, edits] = np.concatenate(at)[order], np.concatenate(marks, axis=1)[:, order]
        return got

    def candidates(self, words: list[str], edits: int) -> dict[str, list[int]]:
        """Of words of one length (2 at least) the numbers of the terms that can be within ``edits``; none that is gets lost.

        An edit changes the length by one at most, puts in or takes out one letter at most, breaks and makes three pairs at most, and
        moves a letter by one place at most.
        """
        out: dict[str, list[int]] = {}
        at, theirs = self._terms_near(len(words[0]), edits)
        for start in range(0, len(words), self.ROWS):
            few = words[start : start + self.ROWS]
            mine = self._marks(_codes(few, len(few[0])), edits)
            lacks = lambda x, y, most: np.bitwise_count(x & ~y) <= most
            i, j = np.nonzero(lacks(theirs[0][None, :], mine[0][:, None], edits) & lacks(mine[0][:, None], theirs[0][None, :], edits))
            for x, y, most in ((1, 1, 3 * edits), (2, 3, edits), (4, 5, edits)):
                keep = lacks(theirs[x, j], mine[y, i], most) & lacks(mine[x, i], theirs[y, j], most)
                i, j = i[keep], j[keep]
            for word, term in zip(i.tolist(), at[j].tolist()):
                out.setdefault(few[word], []).append(term)
        return out

    def within(self, word: str, edits: int, wanted: list[int]) -> bool:
        """Whether one of the terms ``wanted`` (ascending numbers) is within ``edits``, 1 or 2 (a swap of neighbours is one edit).

        The automaton's states are three bit sets: prefixes of the word reached with no, one and two edits. They run down the trie;
        branches with no state left, or that lead to no wanted term, end.
        """
        places: dict[str, int] = {}
        for i, ch in enumerate(word):
            places[ch] = places.get(ch, 0) | 2 << i
        full = (2 << len(word)) - 1
        accept = 1 << len(word)
        two = full if edits > 1 else 0
        stack = [(self.root, 1, 3 & full, 7 & two, 0, 0, 0)]
        while stack:
            (_, _, ends, to), r0, r1, r2, p0, p1, before = stack.pop()
            if ends and (r0 | r1 | r2) & accept:
                return True
            for ch, node in to.items():
                at = bisect_left(wanted, node[0])
                if at == len(wanted) or wanted[at] >= node[1]:
                    continue
                c = places.get(ch, 0)
                swap = c << 1 & before
                n0 = r0 << 1 & c
                n1 = (r1 << 1 & c | r0 | r0 << 1 | n0 << 1 | p0 << 2 & swap) & full
                n2 = (r2 << 1 & c | r1 | r1 << 1 | n1 << 1 | p1 << 2 & swap) & two
                if n0 | n1 | n2:
                    stack.append((node, n0, n1, n2, r0, r1, c))
        return False


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    #: Of bias, abusive exact, abusive misspelled, quoted hits, hits per hundred words; the values before learning.
    weights: list[float] = field(default_factory=lambda: [-4.0, 3.0, 1.5, 0.3, 0.5])


class Scorer:
    #: Words after which the cache starts anew, and texts looked up together.
    CACHE, TEXTS = 300_000, 256

    def __init__(self, model: Model):
        self.model, self.exact = model, Trie()
        for w in model.words:
            self.exact.add(w, "word")
        self.fuzzy = Lexicon([w for w in model.words if len(w) >= 5])
        for s in model.stems:
            self.exact.add(s, "stem")
        self.cache: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Puts words into the cache. 2: a term; 1: a misspelled one; 0: neither. Words of 5 letters and more may be an edit away, of 8 and more two."""
        if len(self.cache) >= self.CACHE:
            self.cache.clear()
        by_size: dict[int, dict[str, list[str]]] = {}
        for word in set(words).difference(self.cache):
            plain = word.translate(SWAPS)
            self.cache[word] = 2 if self.exact.exact(word) else int(plain != word and self.exact.exact(plain))
            if not self.cache[word] and len(word) >= 5:
                by_size.setdefault(len(plain), {}).setdefault(plain, []).append(word)
        for n, group in by_size.items():
            edits = 1 + (n >= 8)
            for plain, wanted in self.fuzzy.candidates(list(group), edits).items():
                if self.fuzzy.within(plain, edits, wanted):
                    self.cache.update(dict.fromkeys(group[plain], 1))

    def kind(self, word: str) -> int:
        self.learn([word])
        return self.cache[word]

    def features(self, texts: Sequence[str | None]) -> Iterator[list[float]]:
        """Of each text: bias, abusive exact, abusive misspelled and quoted hits, hits per hundred words."""
        for at in range(0, len(texts), self.TEXTS):
            lows = [(t or "").lower() for t in texts[at : at + self.TEXTS]]
            words = [TOKEN.findall(low) for low in lows]
            self.learn(chain.from_iterable(words))
            yield from map(self._features, lows, words)

    def _features(self, low: str, words: list[str]) -> list[float]:
        kinds = list(map(self.cache.__getitem__, words))
        if not any(kinds):
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        exact = fuzzy = quoted = 0.0
        for i, m in enumerate(TOKEN.finditer(low)):
            if kinds[i]:
                share = self.quotation(low, m.start(), m.end(), words[max(0, i - 4) : i], words[i + 1 : i + 3])
                quoted += share
                exact += (1 - share) * (kinds[i] == 2)
                fuzzy += (1 - share) * (kinds[i] == 1)
        hits = sum(map(bool, kinds))
        return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * hits / len(words))]

    @staticmethod
    def quotation(text: str, start: int, end: int, before: list[str], after: list[str]) -> float:
        """From the window of a hit: near 1 where it is quoted or spoken about, near 0 where it is aimed at someone."""
        left, right = QUOTES.findall(text[max(0, start - WINDOW) : start]), QUOTES.findall(text[end : end + WINDOW])
        z = -2.0 + 2.5 * (len(left) % 2 == 1 and bool(right)) + 1.5 * any(w in REPORTING for w in before) - 1.5 * any(w in ADDRESS for w in (*before, *after))
        return 1 / (1 + math.exp(-z))

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        sums = (sum(w * x for w, x in zip(self.model.weights, row)) for row in self.features(texts))
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) for z in sums]


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels may be learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def fit_weights(x: np.ndarray, y: np.ndarray, prior: list[float], pull: float = 1.0, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps, drawn to ``prior``: weights that no label speaks about keep it."""
    w = mean = np.array(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + pull * (w - mean))
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least_docs: int = 4, odds: float = 25.0) -> Model:
    """Learns from at most ``sample`` labelled rows that may be learned from (the first by a hash of doc_id; the documented bound).

    Null labels and labels without a document teach nothing; a doc_id labelled twice counts as toxic if one label says so. Without
    labels of both kinds the lexicon is empty and every document gets the same low score. Each term stands in a share of the sample's toxic
    documents, so the sample bounds the terms that reach the driver.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isNotNull() & learnable()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = {r["doc_id"]: int(r["toxic"] > 0) for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if len(set(chosen.values())) < 2:
        return Model([], [])
    rows = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")
    known = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(TOKEN.findall((text or "").lower()))
                stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                seen[toxic].update(words | stems)
                seen[toxic][""] += 1
        both = [*set(seen[0]) | set(seen[1])]
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][t] for t in both], pa.int64()), pa.array([seen[0][t] for t in both], pa.int64())], names=["term", "toxic", "clean"])

    counts = known.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n_toxic, n_clean = max(1, sum(chosen.values())), max(1, len(chosen) - sum(chosen.values()))
    rate = (F.col("a") / n_toxic) / ((F.col("b") + 0.5) / n_clean)
    found = counts.where((F.col("term") != "") & (F.col("a") >= max(least_docs, 0.004 * n_toxic)) & (rate >= odds)).collect()
    stems = sorted({r["term"][:-1] for r in found if r["term"].endswith("*") and r["a"] >= 25 * (r["b"] + 0.5)})
    plain = [r["term"] for r in found if not r["term"].endswith("*")]
    whole = [(r["term"], r["a"]) for r in found if not r["term"].endswith("*")]
    # A beginning is a term of its own only where it stands for several words; else the word itself does.
    many = {s for s in stems if sum(w.startswith(s) for w, _ in whole) >= 3}
    least = {s for s in many if not any(s != t and s.startswith(t) for t in many)}
    model = Model(sorted(w for w in plain if not any(w.startswith(s) for s in least)), sorted(least))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            x = list(scorer.features(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = known.mapInArrow(measure, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()
    if seen:
        x, y, n = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen]), np.array([r["n"] for r in seen])
        model.weights = fit_weights(np.repeat(x, n, 0), np.repeat(y, n), model.weights)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns named in ``keep``; whole texts, null as empty. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.append_column("score", pa.array(scorer.scores(b.column(b.schema.get_field_index("text")).to_pylist()), pa.float64()))

    wanted = list(dict.fromkeys(["doc_id", "text", *keep]))
    given = docs.select(*wanted)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    scored = given.mapInArrow(each, f"{types}, score double")
    held = F.coalesce(~learnable(), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[c for c in wanted if c in keep and c != "doc_id"])

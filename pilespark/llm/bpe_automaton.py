"""BPE encoding and decoding through a minimal acyclic word automaton.

The corpus's frequent words (counted over all documents) are compiled with their ids into an automaton whose states share suffixes;
a word's number in the automaton finds its ids. Tasks memory-map the compiled bytes. Other words go through exact pair merging.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import mmap
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import Encoder, byte_alphabet, tokenizer_content
from .scratch import Scratch

LONGEST_WORD = 64


class Merger:
    """Exact BPE of one pre-tokenised piece: always merges the pair of lowest rank, the leftmost among equals."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()

    def ids(self, piece: str) -> list[int]:
        symbols: list[str | None] = [self.alphabet[b] for b in piece.encode()]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        if len(symbols) <= LONGEST_WORD:
            return self._short(symbols)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else n
                if q < n and (r := self.rank.get((symbols[p], symbols[q]))) is not None:
                    heapq.heappush(heap, (r, p, symbols[p], symbols[q]))
        return [self.vocab[s] for s in symbols if s is not None]

    def _short(self, symbols: list[str]) -> list[int]:
        """The same for few symbols: the least of the neighbours' ranks, looked for anew after each merge, is cheaper than a heap."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return [self.vocab[s] for s in symbols]


def compile_lexicon(lexicon: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words, numbering them in sorted order, followed by their ids.

    Words are added in sorted order; the tail of the previous word that the next one leaves is folded into the register of equal
    states, so suffixes are shared and the automaton is minimal when the last word is in.
    """
    words = sorted(w for w in lexicon if w)
    nodes: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
    register: dict[tuple, int] = {}
    path: list[tuple[int, str, int]] = []
    last = ""

    def fold(depth: int) -> None:
        while len(path) > depth:
            parent, ch, child = path.pop()
            key = (nodes[child][0][0], tuple(nodes[child][1].items()))
            nodes[parent][1][ch] = register.setdefault(key, child)

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        fold(common)
        at = path[-1][2] if path else 0
        for ch in word[common:]:
            nodes.append(([False], {}))
            nodes[at][1][ch] = len(nodes) - 1
            path.append((at, ch, len(nodes) - 1))
            at = len(nodes) - 1
        nodes[at][0][0] = True
        last = word
    fold(0)
    order, size = [0], {}
    number = {0: 0}
    for s in order:
        for t in nodes[s][1].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)

    def reach(s: int) -> int:  # words below a state; depth is bounded by LONGEST_WORD
        if s not in size:
            size[s] = nodes[s][0][0] + sum(map(reach, nodes[s][1].values()))
        return size[s]

    starts, chars, targets, skips, finals = array("i"), array("i"), array("i"), array("i"), array("i")
    for s in order:
        starts.append(len(chars))
        finals.append(nodes[s][0][0])
        skip = int(nodes[s][0][0])
        for ch, t in sorted(nodes[s][1].items()):
            chars.append(ord(ch))
            targets.append(number[t])
            skips.append(skip)
            skip += reach(t)
    starts.append(len(chars))
    cuts, ids = array("i", [0]), array("i")
    for word in words:
        ids.extend(lexicon[word])
        cuts.append(len(ids))
    parts = [starts, finals, chars, targets, skips, cuts, ids]
    return array("i", [len(p) for p in parts]).tobytes() + b"".join(p.tobytes() for p in parts)


class Automaton:
    """Looks words up in the compiled bytes, memory-mapped from an unnamed file."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        at, parts = 7, []
        for n in view[:7]:
            parts.append(view[at : at + n])
            at += n
        self.starts, self.finals, self.chars, self.targets, self.skips, self.cuts, self.all_ids = parts

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def ids(self, word: str) -> list[int] | None:
        state, number = 0, 0
        for ch in word:
            c, end = ord(ch), self.starts[state + 1]
            e = bisect.bisect_left(self.chars, c, self.starts[state], end)
            if e == end or self.chars[e] != c:
                return None
            number += self.skips[e]
            state = self.targets[e]
        return self.all_ids[self.cuts[number] : self.cuts[number + 1]].tolist() if word and self.finals[state] else None


_BYTE_OF = {c: b for b, c in enumerate(byte_alphabet())}


def all_pieces(encoder: Encoder, text: str) -> list[str] | None:
    """The pre-tokenizer's pieces of any text, by the library's normalizer and pre-tokenizer beyond the encoder's letters; None with an added token's string."""
    pieces = encoder.pieces(text)
    if pieces is None and not any(a in text for a in encoder.added):
        normalizer = encoder.tokenizer.normalizer
        normal = normalizer.normalize_str(text) if normalizer else text
        pieces = [bytes(map(_BYTE_OF.__getitem__, piece)).decode() for piece, _ in encoder.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
    return pieces


class WordCodec:
    """Encodes and decodes whole texts; ``decode`` joins tokens with a space, as the library does for a file without a decoder."""

    #: Words in each of the cache's two generations.
    CACHE = 200_000

    def __init__(self, content: str, compiled: bytes):
        self.encoder = Encoder(content)
        model = json.loads(content)["model"]
        self.merger, self.automaton = Merger(model), Automaton(compiled)
        self.token = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in json.loads(content)["added_tokens"]}
        self.cache: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _word(self, word: str) -> tuple[str, str]:
        if len(self.cache) >= self.CACHE:
            self.old = dict(self.cache)
            self.cache.clear()
        out = self.old.get(word)
        if out is None:
            ids = self.automaton.ids(word)
            if ids is None:
                ids = self.merger.ids(word)
            out = (" ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids)))
        self.cache[word] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.both(text)[0].split()))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))

    def both(self, text: str | None) -> tuple[str, str]:
        """Decimal ids and decoded text, each joined by one space."""
        pieces = all_pieces(self.encoder, text or "")
        if pieces is None:
            ids = self.encoder.ids(text)
            return " ".join(map(str, ids)), self.decode(ids)
        cache = self.cache
        found = [cache.get(p) or self._word(p) for p in pieces]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


def frequent_words(docs: DataFrame, content: str, size: int, text_column: str = "text") -> list[str]:
    """The most frequent pre-tokenised words over all documents but those with an added token's string, at most ``size``; only these reach the driver.

    Words are taken by classes of counts, a sixteenth of a doubling wide, from the top as long as whole classes fit; a word that occurs once is not frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(shared.value), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(all_pieces(encoder, text or "") or ())
            if len(seen) > 300_000:
                yield flush()
                seen.clear()
        yield flush()

    counts = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "word string, n long").where(F.length("word") <= LONGEST_WORD)
    totals = counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").select("word", F.floor(16 * F.log2("n")).alias("class"))
    totals = Scratch(docs.sparkSession, "words").write(totals, "totals")
    least, taken = None, 0
    for row in totals.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():  # 1,008 classes at most
        taken += row["words"]
        if taken > size:
            break
        least = row["class"]
    return [] if least is None else [r["word"] for r in totals.where(F.col("class") >= least).select("word").collect()]


def digest(docs: DataFrame, tokenizer: str, lexicon_size: int = 50_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_tokens, sha256 of its decimal ids joined by spaces, sha256 of the text decoded from them.

    A null or empty text has no tokens. Equal or null ids are separate rows; other columns are not read.
    """
    spark = docs.sparkSession
    content = tokenizer_content(tokenizer)
    merger = Merger(json.loads(content)["model"])
    compiled = compile_lexicon({w: merger.ids(w) for w in frequent_words(docs, content, lexicon_size, text_column)})
    shared = spark.sparkContext.broadcast((content, compiled))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = WordCodec(*shared.value), hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids, decoded = codec.both(text)
                rows.append((ids.count(" ") + 1 if ids else 0, sha(ids.encode()).hexdigest(), sha(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

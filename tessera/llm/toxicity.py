"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

Fitting learns a lexicon from labelled rows: words, or word beginnings of whole
families, that many toxic texts hold and clean ones don't. Its terms form a
trie; the product of the trie with the Levenshtein automaton of each term's
allowance is made deterministic once, so that all words of a batch are run
through one transition table at once, misspelled ones included. Each hit's
weight is its measured precision. A hit inside quotation marks, or just after a
word such as "word" or "term", is a mention: mentions alone stay below the
threshold, other hits add up.

Fitting reads at most about ``sample`` rows of each label (the documented
bound); scoring reads every row whole. With no usable labelled row the lexicon
is empty and every score is the base score.

Defined results: null and empty texts get the base score and 0; rows are scored
one by one, so equal texts get equal values; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.7
BASE_SCORE = 0.02
#: Weight of a mention against a use; precision assumed of a misspelling not seen in the sample; least precision of a term.
MENTION, UNSEEN, PRECISE = 0.35, 0.8, 0.97
#: Letters of a word beginning that may stand for a family.
STEMS = (3, 4, 5, 6)
#: Words before a hit that are searched for a word that announces a mention.
CONTEXT = 3
# Words that announce a mention, and pairs of quotation marks.
ANNOUNCE = {"word", "words", "term", "terms", "quote", "quoted", "phrase", "insult", "slur"}
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}

_WORD = re.compile(r"[^\W\d_]+")
_letters: list[np.ndarray] = []


def allowance(term: str) -> int:
    """Edits by which a word may differ from a term; from a word beginning (six letters at most), less."""
    if term.endswith("*"):
        return 1 if len(term) > 6 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Matcher:
    """The automaton's table: state 0 is the start, 1 is dead; columns are letter classes, 0 for letters of no term."""

    terms: list[str]
    alphabet: dict[str, int]
    table: np.ndarray
    term: np.ndarray
    distance: np.ndarray
    final: np.ndarray


def build(terms: list[str]) -> Matcher:
    """Determinise the intersection of the terms' trie with their Levenshtein automata."""
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(terms)) - {"*"}))}
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for k, t in enumerate(terms):
        node = 0
        for c in t.rstrip("*"):
            if alphabet[c] not in children[node]:
                children[node][alphabet[c]] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][alphabet[c]]
        ends[node] = k if ends[node] < 0 or not t.endswith("*") else ends[node]
    spare = [-1] * len(children)  # the largest allowance among a node's terms
    for node in reversed(range(len(children))):
        own = [allowance(terms[ends[node]])] if ends[node] >= 0 else []
        spare[node] = max(own + [spare[c] for c in children[node].values()], default=-1)

    def closed(states: dict[int, int]) -> frozenset:
        """Nodes with the fewest edits each, letters of terms left out included."""
        todo = list(states)
        while todo:
            node = todo.pop()
            for c in children[node].values():
                e = states[node] + 1
                if e <= spare[c] and e < states.get(c, 99):
                    states[c] = e
                    todo.append(c)
        return frozenset(states.items())

    def step(states: frozenset, letter: int) -> frozenset:
        out: dict[int, int] = {}
        for node, e in states:
            if ends[node] >= 0 and terms[ends[node]].endswith("*"):
                out[node] = min(out.get(node, 99), e)  # a word beginning once read stays read
            if e + 1 <= spare[node]:
                out[node] = min(out.get(node, 99), e + 1)
            for c, to in children[node].items():
                cost = e + (c != letter)
                if cost <= spare[to]:
                    out[to] = min(out.get(to, 99), cost)
        return closed(out)

    def result(states: frozenset) -> tuple[int, int, bool]:
        hits = [(e, not terms[ends[n]].endswith("*"), ends[n]) for n, e in states if ends[n] >= 0 and e <= allowance(terms[ends[n]])]
        e, is_word, k = min(hits, default=(0, True, -1))
        return k, e, bool(hits) and not is_word and e == 0

    start = closed({0: 0})
    number = {start: 0, frozenset(): 1}
    order, rows, at = [start, frozenset()], [], 0
    while at < len(order):
        row = []
        done = result(order[at])[2]
        for letter in range(len(alphabet) + 1):
            to = order[at] if done else step(order[at], letter)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
        at += 1
    got = [result(s) for s in order]
    return Matcher(terms, alphabet, np.array(rows, dtype=np.int32), np.array([g[0] for g in got]), np.array([g[1] for g in got]), np.array([g[2] for g in got]))


def _classes(matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    classes = np.zeros(0x110000, dtype=np.int32)
    for c, k in matcher.alphabet.items():
        classes[ord(c)] = k
    return _letters[0], classes


def find(matcher: Matcher, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """(start, end, term, distance) of the lexicon hits in each lower-cased text."""
    letters, classes = _classes(matcher)
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    alpha = letters[code]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], alpha, [False]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    kind = classes[code]
    alive, state, at = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int32), starts.copy()
    while len(alive):
        over = at >= ends[alive]
        stop = over | matcher.final[state]
        for w, s in zip(alive[stop].tolist(), state[stop].tolist(), strict=True):
            if matcher.term[s] >= 0:
                i = int(np.searchsorted(first, starts[w], side="right")) - 1
                out[i].append((int(starts[w] - first[i]), int(ends[w] - first[i]), int(matcher.term[s]), int(matcher.distance[s])))
        go = ~stop
        alive, state, at = alive[go], state[go], at[go]
        state = matcher.table[state, kind[at]]
        live = state != 1
        alive, state, at = alive[live], state[live], at[live] + 1
    return out


class Quotes:
    """Where the quotation marks and line ends of a text are, found once, whatever the length of its lines."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.marks = {p: ([m.start() for m in re.finditer(re.escape(p[0]), text)], [m.start() for m in re.finditer(re.escape(p[1]), text)]) for p in QUOTES.items() if p[0] in text}

    def is_mention(self, start: int, end: int) -> bool:
        """Whether the hit stands inside quotation marks of its line, or after an announcing word."""
        i = bisect_left(self.lines, start)
        a, b = self.lines[i - 1] + 1 if i else 0, self.lines[i] if i < len(self.lines) else len(self.text)
        for (left, right), (opens, closes) in self.marks.items():
            o = bisect_left(opens, start)
            if left == right:
                is_open = (o - bisect_left(opens, a)) % 2 == 1
            else:
                c = bisect_left(closes, start)
                is_open = o > 0 and opens[o - 1] >= max(a, closes[c - 1] + 1 if c else 0)
            if is_open:
                c = bisect_left(closes, end)
                if c < len(closes) and closes[c] < b:
                    return True
        return bool(ANNOUNCE & set(_words_before(self.text, max(a, 0), start)))


def _words_before(text: str, low: int, start: int) -> list[str]:
    """The ``CONTEXT`` words before a place, none of them before ``low``; the text is read backwards as far as they reach."""
    reach = 64
    while True:
        at = max(low, start - reach)
        found = [m for m in _WORD.finditer(text, at, start)]
        if at == low or len(found) > CONTEXT:  # the first word found may be cut
            return [m.group() for m in found[-CONTEXT:]]
        reach *= 4


@dataclass
class ToxicityModel:
    matcher: Matcher
    weight: dict[tuple[int, int], float]

    def score(self, texts: list[str]) -> list[float]:
        low = [t.lower() for t in texts]
        out = []
        for text, hits in zip(low, find(self.matcher, low), strict=True):
            clean, mention = 1.0 - BASE_SCORE, 0.0
            quotes = Quotes(text) if hits else None
            for start, end, term, distance in hits:
                w = self.weight.get((term, distance), UNSEEN)
                if quotes.is_mention(start, end):
                    mention = max(mention, w * MENTION)
                else:
                    clean *= 1 - w
            out.append(1 - clean * (1 - mention))
        return out


def _precision(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    t, c = toxic / max(1, n_toxic), (clean + 0.5) / max(1, n_clean)
    return t / (t + c)


def choose_terms(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, support: int, most: int) -> list[str]:
    """Words, and for families of words the longest beginning that keeps nearly all of the family."""
    good = {t: d for t, (d, c) in counts.items() if d >= support and _precision(d, c, n_toxic, n_clean) >= PRECISE}
    by_stem: dict[str, int] = {}
    for t in good:
        if not t.endswith("*"):
            for n in STEMS:
                if len(t) >= n:
                    by_stem[t[:n]] = max(by_stem.get(t[:n], 0), good[t])
    kept: dict[str, int] = {}
    for stem in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda s: (len(s), s)):
        if any(stem.startswith(s) for s in kept) or by_stem.get(stem, 0) >= 0.7 * good[stem + "*"]:
            continue
        longer = [s[:-1] for s in good if s.endswith("*") and s[:-1].startswith(stem) and good[s] >= 0.9 * good[stem + "*"]]
        best = max(longer, key=lambda s: (len(s), s))
        if by_stem.get(best, 0) < 0.7 * good[best + "*"]:
            kept[best] = good[best + "*"]
    words = {t: d for t, d in good.items() if not t.endswith("*") and len(t) >= 3 and not any(t.startswith(s) for s in kept)}
    every = {**{s + "*": d for s, d in kept.items()}, **words}
    return sorted(sorted(every, key=lambda t: (-every[t], t))[:most])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 2000, most_terms: int = 120) -> ToxicityModel:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; null labels and texts are left out."""
    marks = common.columns_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {int(r["toxic"] > 0): r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.when(F.col("toxic") > 0, F.lit(min(1 << 30, int((1 << 30) * sample / max(1, n.get(1, 0)))))).otherwise(F.lit(min(1 << 30, int((1 << 30) * 2 * sample / max(1, n.get(0, 0))))))
    chosen = F.broadcast(marks.where(place < share))  # about three times `sample` ids at most
    rows = common.save(common.columns_of(docs, "doc_id", "text").where("text is not null").join(chosen, "doc_id").select("text", (F.col("toxic") > 0).alias("toxic")), "labelled").repartition(12)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                if words:
                    sketch = min(common.mix(np.array([hash_of(w) for w in words], dtype=np.uint64)).tolist()) >> 1
                    got |= {(t, toxic, sketch) for w in words for t in [w, *[w[:k] + "*" for k in STEMS if len(w) >= k]] if len(t) <= 40}
                    got.add(("", toxic, sketch))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.int64())], names=["term", "toxic", "sketch"])

    # Near copies have one sketch, so that a text copied many times counts once.
    found = rows.transform(common.map_arrow, terms_of, "term string, toxic boolean, sketch long").distinct().groupBy("term").agg(F.count(F.when(F.col("toxic"), 1)).alias("t"), F.count(F.when(~F.col("toxic"), 1)).alias("c"))
    total = found.where("term = ''").first()
    nt, nc = (total["t"], total["c"]) if total else (0, 0)
    support = max(3, round(0.015 * nt))
    useful = found.where((F.col("term") != "") & (F.col("t") >= support) & (F.col("t") * nc >= 20 * F.col("c") * nt)).orderBy(F.desc("t"), "term").limit(20 * most_terms)
    terms = choose_terms({r["term"]: (r["t"], r["c"]) for r in useful.collect()}, nt, nc, support, most_terms)
    matcher = build(terms)

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                toxic = part.column(1).to_pylist()
                got = [(k, e, x) for x, hits in zip(toxic, find(matcher, [t.lower() for t in part.column(0).to_pylist()]), strict=True) for k, e in {h[2:] for h in hits}]
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))], names=["term", "distance", "toxic"])

    weight = {}
    seen = rows.transform(common.map_arrow, hits_of, "term int, distance int, toxic boolean").groupBy("term", "distance").agg(F.count(F.when(F.col("toxic"), 1)).alias("t"), F.count(F.when(~F.col("toxic"), 1)).alias("c"))
    for r in seen.collect():  # terms x distances
        p = _precision(r["t"] + 0.5, r["c"], nt, nc)
        weight[(r["term"], r["distance"])] = min(0.97, p) if r["c"] == 0 or p >= 0.9 else 0.0 if r["distance"] else p / 2
        if r["distance"] and r["c"] == 0:
            weight[(r["term"], r["distance"])] = max(UNSEEN, weight[(r["term"], r["distance"])])
    return ToxicityModel(matcher, weight)


def hash_of(word: str) -> int:
    import zlib

    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `most_terms` terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                got = np.array(shared.value.score([t or "" for t in part.column(1).to_pylist()]), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.columns_of(docs, "doc_id", "text").transform(common.map_arrow, run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                got = np.array(shared.value.score([t or "" for t in part.column(at).to_pylist()]), dtype=np.float64)
                yield part.filter(pa.array(got < THRESHOLD))

    return docs.transform(common.map_arrow, run, docs.schema)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(common.remainder_of_id(column, 3) == 1, F.lit(False))

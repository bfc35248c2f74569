"""Chinese words and sounds from dictionaries that the caller supplies: none is shipped.

Segmentation finds the likeliest split of each run of Chinese characters into
dictionary words. Sound codes are a letter and the groups of a syllable's initial
and final. Both run in Arrow-batched Python on plain dictionaries, which are sent
to the executors once; ``MOST`` entries at most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sounds of each group.
INITIALS = {1: "b p", 2: "f", 3: "m", 4: "d t", 5: "n l", 6: "g k h", 7: "j q x", 8: "zh ch sh r", 9: "z c s"}
FINALS = {1: "a ia ua", 2: "o uo", 3: "e ie ue ve", 4: "i", 5: "u", 6: "v u:", 7: "ai ei ui uai", 8: "ao ou iu iao", 9: "an en in un vn ang eng ing ong ian uan van iang uang iong er"}
#: The largest dictionary that is sent to executors.
MOST = 2_000_000

_SYLLABLE = re.compile(r"(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw]?)([^0-9]*)([0-9]?)")
_RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿𠀀-𪛟]+|[a-z0-9]+")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿𠀀-𪛟]")
_GROUP = [{s: k for k, names in table.items() for s in names.split()} for table in (INITIALS, FINALS)]


def syllable(pinyin: str) -> tuple[str, str, str]:
    """(initial, final, tone) of a syllable with its tone's number after it; y and w before their own vowels are no initials."""
    initial, final, tone = _SYLLABLE.match(pinyin.strip().lower()).groups()
    if initial == "y" and final.startswith("u"):
        initial, final = "", "v" + final[1:]
    elif initial + final in ("y", "yi", "w", "wu"):
        initial, final = "", {"y": "i", "w": "u"}[initial]
    return initial, final or pinyin.strip().lower().rstrip("0123456789"), tone or "0"


def sound_code(pinyin: str, tone: bool = False) -> str:
    initial, final, number = syllable(pinyin)
    return f"{pinyin.strip()[0].upper()}{_GROUP[0].get(initial, 0)}{_GROUP[1].get(final, 0)}{number if tone else ''}"


def _bounded(table: DataFrame, *columns: str) -> list:
    rows = table.select(*columns).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a dictionary of more than {MOST} entries isn't sent to executors")
    return rows


def sounds(docs: DataFrame, lexicon: DataFrame, column: str = "text", tone: bool = False) -> DataFrame:
    """``doc_id, codes``: a code for each character by ``lexicon(char, pinyin)``; Latin letters are upper-cased, a character without an entry stays, the rest goes."""
    code = {r["char"]: sound_code(r["pinyin"], tone) for r in _bounded(lexicon, "char", "pinyin")}
    shared = docs.sparkSession.sparkContext.broadcast(code)

    def of(c: str) -> str:
        return shared.value.get(c, c) if _HAN.match(c) else c.upper() if c.isalpha() else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "codes": [" ".join(filter(None, map(of, t or ""))) for t in f[column]]})

    return docs.select("doc_id", column).mapInPandas(run, "doc_id long, codes string")


def sound_similarity(a: Column, b: Column, mode: str = "fuzzy") -> Column:
    """Of two code strings: ``exact``, ``fuzzy`` (equal places over the longer length) or ``weighted`` (places weigh 1 / (i + 1))."""
    if mode == "exact":
        return (a == b).cast("double")
    x, y = (F.filter(F.split(s, " "), lambda c: c != "") for s in (a, b))
    w = lambda i: F.lit(1.0) if mode == "fuzzy" else 1 / (i + F.lit(1.0))
    longest = F.greatest(F.size(x), F.size(y))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1))
    add = lambda f: F.aggregate(F.transform(places, f), F.lit(0.0), lambda s, v: s + v)
    same = add(lambda i: F.when(F.get(x, i) == F.get(y, i), w(i)).otherwise(0.0))
    total = add(w)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(same / total)


def split_run(run: str, words: dict[str, float], total: float, longest: int) -> list[str]:
    """The likeliest split of a run into words with counts; an unknown character counts one."""
    n = len(run)
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            count = words.get(run[i:j], 1.0 if j == i + 1 else 0.0)
            if count > 0 and best[i] + math.log(count / total) > best[j]:
                best[j], back[j] = best[i] + math.log(count / total), i
    out, j = [], n
    while j > 0:
        out.append(run[back[j] : j])
        j = back[j]
    return out[::-1]


def segmented(docs: DataFrame, dictionary: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, w``: words by ``dictionary(word, n)``; Latin words and numbers are kept whole, lower-cased."""
    words = {r["word"]: float(r["n"]) for r in _bounded(dictionary, "word", "n")}
    shared = docs.sparkSession.sparkContext.broadcast((words, sum(words.values()) + 1.0, max(map(len, words), default=1)))

    def of(text: str) -> list[str]:
        return [w for run in _RUN.findall(text.lower()) for w in (split_run(run, *shared.value) if _HAN.match(run) else [run])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "w": [of(t or "") for t in f[column]]})

    return docs.select("doc_id", column).mapInPandas(run, "doc_id long, w array<string>")

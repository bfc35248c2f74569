"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut after words whose rolling hash (of the last two words) meets a
mask, so that texts that share a passage share its chunks. A chunk is encoded
once a task and kept. Where two chunks meet, the words beside the cut are
encoded together, with what stands between them, and compared with their separate
ids; chunks whose joins differ are joined and encoded anew by the library, until
all joins that are left agree.

How a new chunk is encoded depends on the tokenizer. One that drops white space
and never lets a token span it (``_words_apart`` probes that) gives a chunk the
ids of its words, each encoded once and kept. Any other encodes a chunk whole,
white space before its first word included. Words are encoded by the library; for
plain ones (letters below U+0300, a full stop or comma after them) only its model
is called, with the letters as its normalizer and byte-level step would give them,
if the tokenizer's results for ``PROBES`` are the same that way (``_plain_words``).

The caches are exact (keyed by the bytes) and bounded; a full one is emptied, and all
are at a task's end, so that an idle worker holds no texts.

Decoding joins the tokens of the ids by a space where the tokenizer file names
no decoder, as its library does, and calls the library otherwise.

Defined results: a null text is the empty text: no ids, empty decoded text;
repeated rows are each encoded; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import common

#: A cut falls after one word in so many, on average.
CHUNK_WORDS = 64
#: Entries of each cache, and the longest word and chunk (in bytes) kept.
CHUNKS, WORDS, JOINS, LONGEST, LONGEST_CHUNK = 8_000, 150_000, 50_000, 80, 1 << 13
# Words of each kind of character, for probing a tokenizer.
PROBES = ("a", "Word", "it's", "'t", "don't", "x1", "2024", "7", "...", "-", "(a)", "é", "Ünder", "日本", "a_b", "<|", "|>", "\u00a0b", "e\u0301")


#: A plain word: letters below U+0300, then one mark or none.
_PLAIN = re.compile("([" + "".join(chr(c) for c in range(0x300) if chr(c).isalpha()) + "]+)([.,]?)")
#: The byte-level step: bytes that print stand for themselves, the others for the characters from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(0x100)) - set(_PRINTED)))}
_BLANK = b"\t\n\x0b\x0c\r "


def little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Bounded(dict):
    """A cache that is emptied when it holds more than ``most`` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


class ChunkEncoder:
    """A tokenizer file's encoder and decoder; ids are little-endian 32-bit, decoded text is UTF-8."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; the library's own threads would only take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.plain = json.load(f)["decoder"] is None
        self.ids, self.decoded = Bounded(WORDS), Bounded(WORDS)  # of words
        self.chunks, self.joins = Bounded(CHUNKS), Bounded(JOINS)
        self.chunks_seen = self.chunks_reused = self.joins_seen = self.joins_repaired = 0
        self.apart = self._words_apart()
        self.stems = Bounded(WORDS)
        self.token = [(self.tokenizer.id_to_token(i) or "").encode() + b" " if self.plain else b"" for i in range(self.tokenizer.get_vocab_size())]
        self.packed = [little_endian([i]) for i in range(len(self.token))]
        self.by_model = self.apart and self._plain_words()

    def _words_apart(self) -> bool:
        """Whether words that white space parts have the ids that they have alone."""
        alone = [i for i, _ in self._library([p.encode() for p in PROBES])]
        gaps = [" ", "\n", "\t ", "  \r\n"]
        pairs = [(i, j, g) for i in range(len(PROBES)) for j in range(len(PROBES)) for g in gaps]
        both = self._library([f"{PROBES[i]}{g}{PROBES[j]}".encode() for i, j, g in pairs])
        return all(got == alone[i] + alone[j] for (i, j, _), (got, _) in zip(pairs, both, strict=True))

    def _library(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, each token with a space after it) of each text, by the library."""
        got = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False) if texts else []
        return [(little_endian(e.ids), (" ".join(e.tokens) + " ").encode() if self.plain and len(e) else b"") for e in got]

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.plain:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return " ".join(map(self.tokenizer.id_to_token, numbers)).encode()

    def _stem(self, stem: str) -> tuple[bytes, bytes]:
        """(ids, tokens) of a plain word's letters, by the tokenizer's model alone."""
        got = self.stems.get(stem)
        if got is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(stem if stem.isascii() else stem.encode().decode("latin-1").translate(_BYTES))]
            got = self.stems[stem] = (b"".join([self.packed[i] for i in ids]), b"".join([self.token[i] for i in ids]))
        return got

    def _plain_words(self) -> bool:
        """Whether the model alone gives the library's results for the plain words among the probes."""
        probes = [p.encode() for p in (*PROBES, "straße", "Æon.", "été,", "ǅ", "Þing", "unbelievably,", "OK.") if _PLAIN.fullmatch(p.lower())]
        tails = {m: self._library([m.encode()])[0] for m in (".", ",")}
        for p, want in zip(probes, self._library(probes), strict=True):
            stem, tail = _PLAIN.fullmatch(p.decode().lower()).groups()
            got = self._stem(stem)
            if tail:
                got = (got[0] + tails[tail][0], got[1] + tails[tail][1])
            if got != want:
                return False
        self.tails = tails
        return True

    def _know(self, words: set[bytes]) -> None:
        """Encode the words that no cache holds."""
        known, stems, rest = self.ids, self.stems, []
        for w in words:
            if w in known:
                continue
            if self.by_model and w.isalpha():  # ASCII letters alone, plain without the expression
                self.ids[w], self.decoded[w] = stems.get(stem := w.lower().decode()) or self._stem(stem)
                continue
            m = _PLAIN.fullmatch(w.decode("utf-8", "replace").lower()) if self.by_model else None
            if m is None:
                rest.append(w)
                continue
            stem, tail = m.groups()
            ids, decoded = stems.get(stem) or self._stem(stem)
            if tail:
                ids, decoded = ids + self.tails[tail][0], decoded + self.tails[tail][1]
            self.ids[w], self.decoded[w] = ids, decoded
        for w, (ids, decoded) in zip(rest, self._library(rest), strict=True):
            self.ids[w], self.decoded[w] = ids, decoded

    def _encode_chunks(self, keys: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        here: dict[bytes, tuple[bytes, bytes]] = {}
        new = []
        for k in set(keys):
            value = self.chunks.get(k)
            if value is None:
                new.append(k)
            else:
                here[k] = value
        self.chunks_seen += len(keys)
        self.chunks_reused += len(keys) - len(new)
        if self.apart:
            split = [k.split() for k in new]
            self._know(set().union(*split))
            ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
            got = [(b"".join(map(ids, ws)), b"".join(map(decoded, ws))) for ws in split]
        else:
            got = self._library(new)
        for k, v in zip(new, got, strict=True):
            here[k] = v
            if len(k) <= LONGEST_CHUNK:
                self.chunks[k] = v
        return here

    def _agree(self, joins: list[tuple[bytes, bytes, bytes]]) -> list[bool]:
        """Whether each (word, what stands between, word) has the ids of its words apart."""
        new = [j for j in set(joins) if j not in self.joins]
        if new:
            ends = [(a, c) if self.apart else (a, b + c) for a, b, c in new]
            together = self._library([a + b + c for a, b, c in new])
            if self.apart:
                self._know({w for e in ends for w in e})
                alone = [self.ids[a] + self.ids[c] for a, c in ends]
            else:
                sides = self._library([w for e in ends for w in e])
                alone = [sides[2 * i][0] + sides[2 * i + 1][0] for i in range(len(ends))]
            for j, (t, _), x in zip(new, together, alone, strict=True):
                self.joins[j] = t == x
        self.joins_seen += len(joins)
        return [self.joins[j] for j in joins]

    def forget(self) -> None:
        for cache in (self.ids, self.decoded, self.stems, self.chunks, self.joins):
            cache.clear()

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        words = common.Words(texts)
        data, starts, ends, offsets = words.data, words.starts, words.ends, words.offsets
        pair = np.concatenate([words.hashes[:1], common.sequence_hashes(words.hashes, 2)])
        cuts = np.setdiff1d(np.flatnonzero(pair % np.uint64(CHUNK_WORDS) == 0) + 1, offsets)  # words before which a chunk begins
        of = np.searchsorted(offsets, cuts, side="right") - 1
        edges, at = [], 0
        for i, t in enumerate(texts):  # byte positions between which a text's chunks lie
            edges.append([at, *ends[cuts[np.searchsorted(of, i) : np.searchsorted(of, i, side="right")] - 1].tolist(), at + len(t)])
            at += len(t) + 1
        piece = (lambda a, b: data[a:b].strip(_BLANK)) if self.apart else (lambda a, b: data[a:b])
        keys = [[piece(a, b) for a, b in zip(e[:-1], e[1:], strict=True)] for e in edges]
        here = self._encode_chunks([k for ks in keys for k in ks])
        l0, l1, r0, r1 = (x.tolist() for x in (starts[cuts - 1], ends[cuts - 1], starts[cuts], ends[cuts]))
        agreed = iter(self._agree([(data[a:b], data[b:c], data[c:d]) for a, b, c, d in zip(l0, l1, r0, r1, strict=True)]))
        out = []
        for e, ks in zip(edges, keys, strict=True):
            good = [next(agreed) for _ in e[1:-1]]
            if all(good):
                parts = [here[k] for k in ks]
            else:
                self.joins_repaired += good.count(False)
                keep = [e[0], *[x for x, g in zip(e[1:-1], good, strict=True) if g], e[-1]]
                whole = [piece(a, b) for a, b in zip(keep[:-1], keep[1:], strict=True)]
                again = dict(zip(whole, self._library(whole), strict=True))
                parts = [again[w] for w in whole]
            ids = b"".join([p[0] for p in parts])
            out.append((ids, b"".join([p[1] for p in parts])[:-1] if self.plain else self.decode(ids)))
        for w in {data[starts[i] : ends[i]] for i in np.flatnonzero(ends - starts > LONGEST).tolist()} if self.apart else ():
            self.ids.pop(w, None)
            self.decoded.pop(w, None)
            self.stems.pop(w.decode("utf-8", "replace").lower().rstrip(".,"), None)
        for cache in (self.ids, self.decoded, self.stems, self.chunks, self.joins):
            cache.trim()
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ship(docs: DataFrame, path: str) -> str:
    """Send the tokenizer file to every executor, for those that don't have it."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids array<long>, decoded string`` of ``docs(doc_id, text)``."""
    name = ship(docs, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for batch in batches:
            for part in common.by_size(batch):
                got = e.encode(common.byte_texts(part.column(1)))
                ids = [np.frombuffer(i, dtype="<u4").astype(np.int64) for i, _ in got]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array([t.decode() for _, t in got], pa.string())], names=["doc_id", "ids", "decoded"])
        e.forget()

    return common.columns_of(docs, "doc_id", "text").transform(common.map_arrow, run, "doc_id long, ids array<long>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: as above, but only digests leave the worker."""
    name = ship(docs, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for batch in batches:
            for part in common.by_size(batch):
                got = e.encode(common.byte_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for _, t in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        e.forget()

    return common.columns_of(docs, "doc_id", "text").transform(common.map_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

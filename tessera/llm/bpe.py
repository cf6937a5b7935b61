"""Byte-level BPE: a backtracking encoder that needs no merge loop, and a decoder by offsets.

A token sequence is what the merges of BPE give exactly if each neighbouring pair is
compatible: BPE applied to the two tokens' bytes gives the two tokens again. The
encoder takes the longest token matches of an Aho-Corasick automaton, checks
neighbours against a table of pairs, and steps back to a shorter match where a pair is
incompatible. Every position and token is refused at most once, so time is linear.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Fixed value: the vocabulary's own split pattern, with the white space of the tokenizers library spelled out.
_SPACE = r"\t-\r\x20\x85\xA0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words whose ids, and pairs whose verdicts, a worker keeps; a full store is emptied.
KEPT_WORDS, KEPT_PAIRS = 800_000, 1_000_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes
    stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class ByteBPE:
    """Encoder and decoder over a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # Latin-1 strings hold one byte a character, which the automaton can read.
        text = {i: bytes(byte[c] for c in s).decode("latin-1") for s, i in vocab.items()}
        self.id_of = {s: i for i, s in text.items()}
        size = 1 + max([*text, *self.special.values()])
        self.rank = [0] * size  # when a token is merged; bytes come first
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for k, m in enumerate(spec["model"]["merges"], start=1):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if self.rank[whole] == 0:
                self.rank[whole], self.parts[whole] = k, (left, right)
            self.merged.setdefault((left, right), k)
        self.longest = ahocorasick.Automaton()
        for i, s in text.items():
            self.longest.add_word(s, (len(s), i))
        self.longest.make_automaton()
        self.length = [len(text.get(i, "")) for i in range(size)]
        # The next shorter token that starts a token, as a chain for stepping back.
        self.shorter = [-1] * size
        for i, s in text.items():
            self.shorter[i] = next((self.id_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.id_of), -1)
        blob = [text[i].encode("latin-1") if i in text else b"" for i in range(size)]
        for s, i in self.special.items():
            blob[i] = s.encode()
        self.bytes = np.frombuffer(b"".join(blob), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        self.digits = [str(i) for i in range(size)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}  # the ids of a word

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b standing next to each other as they are.

        Undoes the merges of both from the last one on. At each step the two tokens at the
        seam could have been merged; the pair breaks if that merge comes before the
        step that was undone.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        rank, parts, merged = self.rank, self.parts, self.merged
        left, right, fine = a, b, True
        before = len(self.digits) * 2.0  # merges from this one on came too late
        while True:
            seam = merged.get((left, right))
            if seam is not None and seam < before:
                fine = False
                break
            if rank[left] == 0 and rank[right] == 0:
                break
            # Of equal ranks the left one merges first, so the right one is undone first.
            if rank[left] > rank[right]:
                before, left = rank[left], parts[left][1]
            else:
                before, right = rank[right] + 0.5, parts[right][0]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = fine
        return fine

    def word(self, s: str) -> tuple[int, ...]:
        """The ids of one word given as a Latin-1 string of its bytes."""
        whole = self.id_of.get(s)
        if whole is not None and self._stands(whole):
            return (whole,)
        found = [i for _, (_, i) in self.longest.iter_long(s)]
        compatible = self.compatible
        if all(map(compatible, found, found[1:])):
            return tuple(found)
        return self._back(s)

    def _stands(self, token: int) -> bool:
        """Whether BPE on a token's own bytes gives the token (its halves stand until merged)."""
        left, right = self.parts[token]
        return self.rank[token] == 0 or self._joins(left, right, self.rank[token])

    def _joins(self, left: int, right: int, k: int) -> bool:
        return self._stands(left) and self._stands(right) and self._until(left, right, k)

    def _until(self, left: int, right: int, k: int) -> bool:
        before = float(k)
        a, b = left, right
        while self.rank[a] or self.rank[b]:
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.parts[a][1]
            else:
                before, b = self.rank[b] + 0.5, self.parts[b][0]
            seam = self.merged.get((a, b))
            if seam is not None and seam < before:
                return False
        return True

    def _back(self, s: str) -> tuple[int, ...]:
        """Longest matches, with steps back to shorter ones."""
        n, out, at = len(s), [], 0
        at_start: list[int] = [-1] * n  # the longest match from each position
        for end, (length, i) in self.longest.iter(s):
            start = end - length + 1
            if at_start[start] < 0 or self.length[at_start[start]] < length:
                at_start[start] = i
        open_end = bytearray([1]) * (n + 1)  # ends from which the rest may still be encoded
        token = at_start[0]
        while True:
            end = at + self.length[token]
            if open_end[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, at_start[end]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: give up the token before
                open_end[at] = 0
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens in it included as the tokenizers library reads them."""
        ids: list[np.ndarray] = []
        for part in self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]:
            if part in self.special:
                ids.append(np.array([self.special[part]], np.int64))
                continue
            ids.append(self._plain(part))
        return np.concatenate(ids) if ids else np.empty(0, np.int64)

    def _packed(self, text: str) -> bytes:
        """The ids of a text without special tokens, as 32-bit numbers."""
        words, kept = self.split.findall(text), self.kept
        for w in set(words):
            if w not in kept:
                kept[w] = np.array(self.word(w.encode("utf-8").decode("latin-1")), "<i4").tobytes()
        return b"".join(map(kept.__getitem__, words))

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        return np.frombuffer(self._packed(text), "<i4").astype(np.int64)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        total = int(size.sum())
        if not total:
            return b""
        first = np.cumsum(size) - size
        where = np.arange(total, dtype=np.int64) + np.repeat(start - first, size)
        return self.bytes[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts; null is empty and gives no ids. Rows repeat as they come."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id lists; null is empty. Bytes that are no UTF-8 decode to U+FFFD."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts, encoded and decoded again in one pass."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            n, shas, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, out)

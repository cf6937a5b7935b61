"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most ``capacity`` tokens. How pieces fill
sequences depends on their lengths only, so the plan is made from the histogram
of lengths (at most ``capacity`` numbers, however large the corpus). The plan
says how many sequences hold which lengths; pieces then take the places planned
for their length by their rank among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from operator import itemgetter
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank, keep, prepare, tidy

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY, END_ID = 4096, 1
#: Words whose ids a task keeps; the store is emptied when it is full.
KEPT_WORDS = 600_000
RANK_CHUNKS = 16


# ---------------------------------------------------------------- plan


class _Stock:
    """Pieces left of each length, with hashed sums of one, two and three lengths."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.there = self.left > 0
        self.pairs: dict[int, tuple[int, int]] = {}
        self.triples: dict[int, tuple[int, int, int]] = {}

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] <= 0:
            self.there[length] = False

    def has(self, lengths: tuple[int, ...]) -> int:
        """How often ``lengths`` can be taken together."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths)) if lengths else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths that sum to ``total``; the larger one as large as can be."""
        if total < 2:
            return None
        known = self.pairs.get(total)
        if known and (known == (0, 0) or self.has(known)):
            return known if known != (0, 0) else None
        # Counts only fall, so a total once found to be out of reach stays so.
        top = known[0] if known else total - 1
        low = (total + 1) // 2
        larger = np.arange(top, low - 1, -1)
        ok = np.flatnonzero(self.there[larger] & self.there[total - larger])
        for i in ok:
            got = (int(larger[i]), total - int(larger[i]))
            if self.has(got):
                self.pairs[total] = got
                return got
        self.pairs[total] = (0, 0)
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        if total < 3:
            return None
        known = self.triples.get(total)
        if known and (known == (0, 0, 0) or self.has(known)):
            return known if known != (0, 0, 0) else None
        top = known[0] if known else total - 2
        for first in top - np.flatnonzero(self.there[top:0:-1]):
            rest = self.pair(total - int(first))
            if rest and rest[0] <= first and self.has((int(first), *rest)):
                self.triples[total] = (int(first), *rest)
                return self.triples[total]
        self.triples[total] = (0, 0, 0)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap`` exactly."""
        if self.there[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def largest(self, most: int) -> int:
        found = np.flatnonzero(self.there[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(sequences, their lengths) for pieces given as counts by length.

    Sequences are opened by the longest piece left. A gap that one, two or three
    lengths fill exactly is filled so; otherwise the longest piece that fits goes in
    (best fit) and the smaller gap is tried again. Alike sequences are made together,
    as many as the scarcest length allows, so the work follows the number of different
    lengths and not the number of pieces.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        have[length] = n
    stock, made = _Stock(have), []
    longest = capacity
    while longest := stock.largest(longest):
        held: tuple[int, ...] = (longest,)
        gap = capacity - longest
        while gap:
            fill = stock.exact(gap)
            if fill and stock.has(held + fill):
                held += fill
                break
            best = stock.largest(gap)
            while best and not stock.has((*held, best)):
                best = stock.largest(best - 1)
            if not best:
                break
            held += (best,)
            gap -= best
        n = stock.has(held)
        for x in set(held):
            stock.take(x, n * held.count(x))
        made.append((n, held))
    return made


# ---------------------------------------------------------------- tokens


#: Fixed value: the word pattern of the vocabulary, with the white space of the tokenizers library spelled out.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xA0  -     　\p{L}\p{N}]+"


#: Code points below this one are left as they are by Unicode composition.
_COMPOSES = regex.compile("[^\0-\u02ff]")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Texts whose new words are looked up together.
LEARN_ROWS = 128


def _unassigned() -> str:
    """A character class of the code points without a character: there, Unicode tables of libraries differ."""
    out, start = [], None
    for i in range(0x110001):
        free = i < 0x110000 and unicodedata.category(chr(i)) == "Cn"
        if free and start is None:
            start = i
        elif not free and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "[" + "".join(out) + "]"


class WordTokenizer:
    """Ids as the tokenizers library gives them, with the ids of each word kept.

    The vocabulary splits text into words after normalizing it, and no merge crosses
    a word, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.compose = normalizers.NFC().normalize_str
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.odd = re.compile(_unassigned())
        # Words come to it normalized and split, many in a text with a space between, so it need not do that again.
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        spec = json.load(open(path, encoding="utf-8"))
        # Each word's last token, and no other, has the suffix.
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        self.last[[i for x, i in spec["model"]["vocab"].items() if x.endswith(suffix)]] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.units: dict[str, bytes] = {}  # the ids of what stands between white space and of words of letters in it, as unsigned 32-bit numbers
        self.pieces: dict[str, bytes] = {}  # the ids of its other parts: digits, signs and endings

    def _units(self, text: str) -> list[str]:
        if _COMPOSES.search(text):
            text = self.compose(text)
        # One code point at a time: str.lower() alone treats a final sigma by its neighbours.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        # str.split() takes four separators for white space that the library does not.
        return self.words.findall(text) if _SEPARATORS.search(text) else text.split()

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by one text for the library: an answer of its own for each word takes longer than its merges."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        raw, stops = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of new units, which the stores keep too."""
        if len(self.units) + 2 * len(units) > KEPT_WORDS:
            self.units.clear()
        if len(self.pieces) + len(units) > KEPT_WORDS:
            self.pieces.clear()
        plain = {u for u in units if u.isalpha()}  # one word of letters, which the pattern leaves whole
        mixed = {u: self.words.findall(u) for u in units if u not in plain}
        parts = set().union(*mixed.values())
        out: dict[str, bytes] = {p: ids for p in parts if (ids := (self.units if p.isalpha() else self.pieces).get(p)) is not None}
        new = [p for p in plain | parts if p not in out]
        for p, ids in zip(new, self._encode(new), strict=True):
            out[p] = (self.units if p.isalpha() else self.pieces)[p] = ids
        for u, own in mixed.items():
            out[u] = self.units[u] = b"".join(map(out.__getitem__, own))
        return out

    def _sections(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        for at in range(0, len(texts), LEARN_ROWS):
            split = [[x if x in self.special or self._needs_whole(x) else self._units(x) for x in self._sections(t or "")] for t in texts[at : at + LEARN_ROWS]]
            wanted: set[str] = set().union(*(x for own in split for x in own if not isinstance(x, str)))
            # The large store is asked once for each unit of a group, not once for each place.
            known = dict(zip(wanted, map(self.units.get, wanted), strict=True))
            if missing := [u for u, ids in known.items() if ids is None]:
                known |= self._learn(missing)
            for own in split:
                raw = b"".join(self._text(x) if isinstance(x, str) else b"".join(map(known.__getitem__, x)) for x in own)
                yield np.frombuffer(raw, "<u4")

    def forget(self) -> None:
        """Empties the stores of words."""
        self.units.clear()
        self.pieces.clear()

    @cached_property
    def whole(self) -> Tokenizer:
        """The library's own tokenizer, which few texts need."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def _needs_whole(self, text: str) -> bool:
        return bool(_COMPOSES.search(text) and self.odd.search(text))

    def _text(self, text: str) -> bytes:
        """The ids of a special token, or of a text that the library has to read as a whole."""
        return array("I", [self.special[text]] if text in self.special else self.whole.encode(text, add_special_tokens=False).ids).tobytes()


_LOADED: dict[str, WordTokenizer] = {}
_STORE = "word tokenizers"


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path] = WordTokenizer(path)
        keep(_STORE, _LOADED)
    return _LOADED[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null or empty text has the end id alone. Repeated rows give repeated pieces.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.batch(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(names))
        tok.forget()  # else each of an executor's workers, busy or not, would hold words

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, _STORE), _PIECES)


def _places(made: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, places, first sequence, place, offset): rank r of a length
    in [first, first + ranks) goes to sequence (first sequence + (r - first) // places) if
    (r - first) % places is ``place``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, lengths in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, own in offsets.items():
            first = used.get(x, 0)
            used[x] = first + n * len(own)
            rows += [(x, first, n * len(own), len(own), sequence, k, o) for k, o in enumerate(own)]
        sequence += n
    return rows


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, chunks: int = RANK_CHUNKS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    The histogram collected for the plan has at most ``capacity`` rows. Each step of the
    plan uses up a length, so the broadcast plan is bounded by ``capacity`` too. An empty
    table gives an empty result.
    """
    spark = pieces_df.sparkSession
    own = cut(pieces_df)
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list] = {}
    for row in _places(plan(counts, capacity)):
        by_length.setdefault(row[0], []).append(row[1:])
    kind = "length long, steps array<struct<first: long, ranks: long, places: long, sequence: long, offsets: array<long>>>"
    rows = []
    for length, steps in by_length.items():
        merged: dict[int, list] = {}
        for first, ranks, places, sequence, _, offset in sorted(steps, key=itemgetter(0, 4)):
            merged.setdefault(first, [first, ranks, places, sequence, []])[4].append(offset)
        rows.append((length, [tuple(x) for x in merged.values()]))
    # Steps of one length, one row each: an equi-join on the length and a range test on the rank.
    table = spark.createDataFrame(rows, kind)
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int")
    ranked = gapless_rank(own, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], chunk, chunks, "_t_rank")
    joined = ranked.join(F.broadcast(table), "length")
    step = F.element_at(F.filter("steps", lambda s: (F.col("_t_rank") >= s["first"]) & (F.col("_t_rank") < s["first"] + s["ranks"])), 1)
    past = F.col("_t_rank") - F.col("_t_step.first")
    return joined.withColumn("_t_step", step).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_t_step.sequence") + F.floor(past / F.col("_t_step.places"))).cast("long").alias("sequence_id"),
        F.element_at("_t_step.offsets", (F.pmod(past, F.col("_t_step.places")) + 1).cast("int")).alias("offset"),
    )

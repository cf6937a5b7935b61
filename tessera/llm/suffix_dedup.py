"""Repeated substrings by distributed prefix doubling over content-defined blocks.

A suffix array sorts suffixes by doubling: a string of 2l bytes is named by the pair of
the names of its halves, and suffixes drop out once their name is unique or the wanted
length is reached. Here names are 64-bit mixes of such pairs, so a task doubles its own
texts without exchange, and Spark sorts (name, position) rows to find which are unique.

Sorting every byte position is what makes the plain method too large, so positions go in
blocks. Each window of ``length`` bytes has an anchor, the least-named short gram in it,
found from its own bytes alone; windows with one anchor and nearly the same distance to it form a
block. Equal windows have equal anchors and distances, so they lie in blocks that agree on
the bytes shared by all windows of the block (its core). Round 1 sorts cores of blocks of 64:
unique ones drop out, equal blocks repeat as a whole. What shares a core and still differs
is split into blocks of 8, then of 1, whose cores are the windows themselves. The cores grow
from round to round, up to the full length, so the last round decides every window exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, prepare, tidy

LENGTH = 400
BLOCKS = (64, 8, 1)
GRAM = 16
SEGMENT = 1 << 19
FILTER_BITS = 22
_PAIR = np.uint64(0xD6E8FEB86659FD93)


class Names:
    """Names of the substrings of a text, doubled up to ``length``."""

    def __init__(self, raw: np.ndarray, length: int):
        self.of = {1: mix64((raw.astype(np.uint64) + np.uint64(1)) * _PAIR)}
        size = 1
        while size * 2 <= min(length, len(raw)):
            h = self.of[size]
            self.of[size * 2] = mix64(h[:-size] * _PAIR + h[size:])
            size *= 2

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        """Names of the strings of ``size`` bytes that begin at ``start``: a pair that overlaps in the middle."""
        half = 1 << (size.bit_length() - 1)
        h = self.of[half]
        return mix64(h[start] * _PAIR + h[start + (size - half)] + np.uint64(size))


def _anchors(names: Names, n: int, length: int) -> np.ndarray:
    """For each window its anchor: the leftmost gram of least name. n is the number of windows."""
    gram = min(GRAM, 1 << (length.bit_length() - 1))
    h = names.of[gram]
    bits = np.uint64(SEGMENT.bit_length() + 1)
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (mix64(h + np.uint64(77)) & ~low) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    least = key
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least[:n] & low).astype(np.int64)


def blocks(raw: np.ndarray, length: int, size: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core, full, start, windows) of each block of at most ``size`` windows.

    ``full`` names all bytes of the block with their place relative to the anchor. ``only`` marks the
    windows that take part.
    """
    out: list[tuple] = []
    for base in range(0, max(1, len(raw) - length + 1), SEGMENT):
        part = raw[base : base + SEGMENT + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            break
        names = Names(part, length)
        start = np.arange(n)
        anchor = _anchors(names, n, length)
        block = (anchor - start) // size
        change = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
        if only is not None:
            own = only[base : base + n]
            change |= own[1:] != own[:-1]
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        last = np.append(first[1:], n) - 1
        if only is not None:
            taken = own[first]
            first, last = first[taken], last[taken]
        if not len(first):
            continue
        a, b = anchor[first], block[first]
        core = mix64(names.at(a - size * b, length - size + 1) + (b.astype(np.uint64) + np.uint64(1)) * _PAIR)
        place = ((a - first) * (size + 1) + (last - first)).astype(np.uint64)
        full = mix64(mix64(names.at(first, length) * _PAIR + names.at(last, length)) + place * _PAIR)
        out.append((core.view(np.int64), full.view(np.int64), first + base, last - first + 1))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


_BLOCKS = "core long, full long, key long, start int, windows int, covered boolean"


def _batch(cols: list[tuple], covered: list[np.ndarray]) -> pa.RecordBatch:
    core, full, key, start, n = (np.concatenate([c[i] for c in cols]) for i in range(5))
    arrays = [pa.array(core), pa.array(full), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.concatenate(covered))]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _BLOCKS.split(", ")])


def _first_blocks(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                core, full, start, n = blocks(_raw(text), length, min(BLOCKS[0], length))
                if len(core):
                    cols.append((core, full, np.full(len(core), key, np.int64), start, n))
            if cols:
                yield _batch(cols, [np.zeros(len(c[0]), bool) for c in cols])

    return docs.mapInArrow(tidy(run), _BLOCKS)


def _next_blocks(with_parts: DataFrame, length: int, size: int) -> DataFrame:
    """Smaller blocks of (key, text, parts), where parts are blocks of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, covered = [], []
            for key, text, parts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = _raw(text)
                for flag in (False, True):
                    only = np.zeros(len(raw), bool)
                    for p in parts:
                        if p["covered"] == flag:
                            only[p["start"] : p["start"] + p["windows"]] = True
                    if only.any():
                        core, full, start, n = blocks(raw, length, size, only)
                        cols.append((core, full, np.full(len(core), key, np.int64), start, n))
                        covered.append(np.full(len(core), flag))
            if cols:
                yield _batch(cols, covered)

    return with_parts.mapInArrow(tidy(run), _BLOCKS)


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks that repeat as a whole, one block of each kind whose core has other kinds too)."""
    core, full = Window.partitionBy("core"), Window.partitionBy("core", "full")
    ranked = rows.select(
        "*",
        F.count(F.lit(1)).over(full).alias("same"),
        F.row_number().over(full.orderBy("key", "start")).alias("nth"),
        (F.min("full").over(core) != F.max("full").over(core)).alias("mixed"),
    )
    kept = cut(ranked.where("(same >= 2 and not covered) or (mixed and nth = 1)").select("key", "start", "windows", "covered", "same", "nth", "mixed"))
    repeated = kept.where("same >= 2 and not covered").select("key", "start", "windows")
    undecided = kept.where("mixed and nth = 1").select("key", "start", "windows", (F.col("covered") | (F.col("same") >= 2)).alias("covered"))
    return repeated, undecided


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(keys: DataFrame) -> Broadcast:
    """A bit map of hashed keys: 2^FILTER_BITS bits whatever their number. It lets some others through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[_slots(b.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(1 << FILTER_BITS, bool)
    for r in keys.coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8)).astype(bool)
    return keys.sparkSession.sparkContext.broadcast(out)


def _passes(sent: Broadcast, key: Column) -> Column:
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(sent.value[_slots(keys.to_numpy())])

    return F.pandas_udf(run, "boolean")(key)


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): the maximal byte ranges of (key long, text) covered by strings of ``length`` bytes
    that begin more than once in the table. Keys without such ranges have no row."""
    if length < 1:
        raise ValueError("length must be positive")
    prepare(docs.sparkSession)
    repeated, undecided = _round(_first_blocks(docs, length))
    found = [repeated]
    before = min(BLOCKS[0], length)
    for size in BLOCKS[1:]:
        if size >= before:
            continue
        sent = _filter(undecided.select("key"))
        parts = undecided.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "covered")).alias("parts"))
        texts = docs.where(_passes(sent, F.col("key")))
        repeated, undecided = _round(_next_blocks(texts.join(parts, "key").select("key", "text", "parts"), length, size))
        found.append(repeated)
        before = size
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            out = []
            for own in b.column(1).to_pylist():
                merged: list[dict] = []
                for p in sorted(own, key=lambda x: x["start"]):
                    stop = p["start"] + p["windows"] + length - 1
                    if merged and p["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(stop, merged[-1]["stop"])
                    else:
                        merged.append({"start": p["start"], "stop": stop})
                out.append(merged)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["key", "spans"])

    lists = every.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("own"))
    return cut(lists.mapInArrow(merge, "key long, spans array<struct<start: int, stop: int>>"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def with_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, out: str = "_t_spans") -> DataFrame:
    """Adds ``out``, the repeated byte ranges of each row's text (null if there are none).

    Rows are told apart by id and text, so a repeated row repeats its text. Only texts that may have ranges
    are shuffled. Null texts have none.
    """
    keyed = df.withColumn("_t_key", _key(id_col, text_col))
    found = spans(keyed.select(F.col("_t_key").alias("key"), F.col(text_col).alias("text")), length)
    sent = _filter(found.select("key"))
    marked = keyed.withColumn("_t_hit", _passes(sent, F.col("_t_key")))
    none = F.lit(None).cast("array<struct<start: int, stop: int>>").alias(out)
    hit = marked.where("_t_hit").join(found.select(F.col("key").alias("_t_key"), F.col("spans").alias(out)), "_t_key", "left")
    rest = marked.where("not _t_hit").select("*", none)
    return hit.unionByName(rest).drop("_t_key", "_t_hit")


def _without(raw: bytes, cuts: list[dict] | None) -> bytes:
    if not cuts:
        return raw
    edges = [0, *(x for c in cuts for x in (c["start"], c["stop"])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row; an empty table gives an empty result.

    ``text`` is what is kept, without bytes of characters that a cut has split; a null text stays null.
    """
    marked = with_spans(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept = _without(raw, cuts)
                left = text if kept is raw else kept.decode("utf-8", "ignore")
                rows.append((len(raw), len(raw) - len(kept), len(cuts or ()), hashlib.sha256(kept).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return marked.select("doc_id", "text", "_t_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def strip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row with its repeated ranges cut out of the text; other columns stay.

    Bytes of a character that a range cuts in two go with the range. Null texts stay null.
    """
    marked = with_spans(df, id_col, text_col, length)

    def run(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, c in zip(texts, cuts, strict=True):
            if text is None or c is None or not len(c):
                out.append(text)
            else:
                out.append(_without(text.encode("utf-8", "surrogatepass"), list(c)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    stripped = F.when(F.col("_t_spans").isNull(), F.col(text_col)).otherwise(F.pandas_udf(run, "string")(F.col(text_col), F.col("_t_spans")))
    return marked.withColumn(text_col, stripped).select(*df.columns)

"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles, ordered by a global order that puts rare
shingles first. Two sets of similarity t share at least l of the first
``n - ceil(t * n) + l`` shingles of either, for any l. Each document chooses its own l
by the estimated cost: a longer prefix means more postings, but a candidate must then
share more of them. A pair becomes a candidate if it shares the smaller l of the two,
and is verified on the full sets. Places count: a pair of sizes n and m needs more than
``ceil(t * n)`` in common, so only the shingles before a place that follows from both sizes matter.

Steps: (1) one pass over the texts gives the set's size and class (equal sets are one
class) and a sketch of shingle counts over all documents; (2) a second pass gives
postings of prefixes, one class once a task; (3) the members of each posting list are compared
with a few heads of it only, which joins most groups of near copies in linear work; (4)
what is still in different groups and shares enough is compared exactly, so no
link is lost; (5) components of the groups. Candidates must also pass a bound by parity maps of the whole sets. Only sets of candidates are shuffled for verification.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, key_filter, lower_ascii, prepare, release, shingle_hashes, tidy
from .components import components

SHINGLE, SIMILARITY = 5, (80, 100)
#: log2 of the sketch's counters. The sketch only orders shingles; any order gives the same links.
SKETCH_BITS, SLICE_BITS = 23, 19
#: The largest number of shared prefix shingles a document may ask for, and the cost of a
#: verification as posting reads for each shingle of the set.
MOST_MATCHES, VERIFY_COST = 4, 0.1
#: Random heads of each list in the round of stars.
HEADS = 3
#: Classes a task remembers to pass by copies; the memory is emptied when it is full.
SEEN = 500_000


def _needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any set that is similar enough."""
    return -(-num * n // den)


def _class_of(h: np.ndarray) -> int:
    """A 63-bit name of a set of hashes."""
    a, b = zlib.crc32(h.tobytes()), int(np.bitwise_xor.reduce(h * np.uint64(0x9E3779B97F4A7C15)))
    mixed = (int(h.sum(dtype=np.uint64)) * 0xD6E8FEB86659FD93 + b * 0xBF58476D1CE4E5B9 + a * 0x94D049BB133111EB) & (2**64 - 1)
    return (mixed ^ (mixed >> 29)) & (2**63 - 1)


class _Seen:
    def __init__(self) -> None:
        self.have: set[int] = set()

    def __call__(self, c: int) -> bool:
        if c in self.have:
            return True
        if len(self.have) >= SEEN:
            self.have.clear()
        self.have.add(c)
        return False


#: Longs of a set's parity map, which bounds from below by how many shingles two sets differ.
PARITY_WORDS = 8
_PARITY = [f"m{i}" for i in range(PARITY_WORDS)]
_SCAN = f"doc_id long, row long, cls long, n int, {', '.join(f'{m} long' for m in _PARITY)}, slice int, counts binary"


def _parity(h: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS buckets of hashes whether it holds an odd number."""
    at = (h >> np.uint64(20)).astype(np.int64) & (64 * PARITY_WORDS - 1)
    return np.packbits(np.bincount(at, minlength=64 * PARITY_WORDS).astype(np.uint8) & 1).view(np.int64)


def _may(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sets can be similar: a shingle that only one has turns one bit, and a pair may differ by so many at most."""
    turned = sum((F.bit_count(F.col(f"{a}_{m}").bitwiseXOR(F.col(f"{b}_{m}"))) for m in _PARITY), F.lit(0))
    fits = (F.col(f"{a}_n") * den >= F.col(f"{b}_n") * num) & (F.col(f"{b}_n") * den >= F.col(f"{a}_n") * num)
    return fits & (turned * (num + den) <= (F.col(f"{a}_n") + F.col(f"{b}_n")) * (den - num))


def _packed(counts: np.ndarray) -> bytes:
    """Counts as four planes of bytes, of which a task's small counts leave three empty."""
    return zlib.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _scan(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows of documents (slice is null) and rows of the sketch (doc_id, cls and n are null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), _Seen()
        fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), *((m, pa.int64()) for m in _PARITY), ("slice", pa.int32()), ("counts", pa.binary())]
        schema, any_rows = pa.schema(fields), False
        pending: list[np.ndarray] = []
        for b in batches:
            any_rows = True
            cls, size, maps = [], [], np.zeros((b.num_rows, PARITY_WORDS), np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                h = shingle_hashes(lower_ascii(text), shingle)
                size.append(len(h))
                maps[i] = _parity(h)
                cls.append(_class_of(h) if len(h) else None)
                if len(h) and not seen(cls[-1]):
                    pending.append((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
            if pending:
                np.add.at(sketch, np.concatenate(pending), np.uint32(1))
                pending.clear()
            n = len(cls)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), *[pa.array(maps[:, i]) for i in range(PARITY_WORDS)], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if any_rows:
            width = 1 << SLICE_BITS
            parts = [_packed(sketch[i : i + width]) for i in range(0, len(sketch), width)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64()) for _ in range(3)], pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64()) for _ in _PARITY], pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return docs.mapInArrow(tidy(run), _SCAN)


def _levels(scan: DataFrame) -> np.ndarray:
    """The summed sketch as counts that fit 16 bits; 2^SKETCH_BITS of them whatever the corpus."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = _unpacked(raw).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        if total:
            small = [np.minimum(4 * np.log2(v + 1.0), 255).astype(np.uint8).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(small, pa.binary())], ["slice", "levels"])

    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    rows = scan.where("slice is not null").select("slice", "counts").repartition(slices, "slice").mapInArrow(merge, "slice int, levels binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        out[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["levels"], np.uint8)
    return out


def _middle(level: np.ndarray, held: np.ndarray) -> float:
    """The median of held[level], for rising ``held``, without an array of that size."""
    width = 1 << SLICE_BITS
    up_to = np.cumsum(sum(np.bincount(level[i : i + width], minlength=len(held)) for i in range(0, len(level), width)))
    low, high = np.searchsorted(up_to, [(len(level) + 1) // 2, len(level) // 2 + 1])
    return float((held[low] + held[high]) / 2)


def choose_matches(df_counts: np.ndarray, n: int, num: int, den: int) -> int:
    """How many shared prefix shingles to ask for, by estimated cost.

    ``df_counts`` estimates in how many other documents each shingle (rarest first) is. Asking for l
    reads the postings of the l-prefix and verifies at most (postings read) / l candidates.
    """
    base = n - _needed(n, num, den)
    most = min(MOST_MATCHES, n - base)
    read = np.cumsum(df_counts[: base + most])[base : base + most]
    asked = np.arange(1, most + 1)
    return int(np.argmin(asked + read + read / asked * (VERIFY_COST * n))) + 1


#: ``place`` packs the shingle's place in the document's order with the matches it asks for.
_POSTINGS = "token long, cls long, n int, place int"
_PLACE_BITS = 4


def _postings(docs: DataFrame, levels: Broadcast, shingle: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, _Seen()
        held = np.exp2(np.arange(256) / 4.0) - 1.0
        floor = _middle(level, held)
        for b in batches:
            tokens, cls, size, asked = [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(lower_ascii(text), shingle)
                if not len(h) or seen(c := _class_of(h)):
                    continue
                own = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(own, kind="stable")  # by level, then by hash
                others = np.maximum(held[own[order]] - floor * 1.5 - 1.0, 0.0)
                matches = choose_matches(others, len(h), num, den)
                prefix = h[order[: len(h) - _needed(len(h), num, den) + matches]]
                tokens.append(prefix.view(np.int64))
                cls.append(np.full(len(prefix), c, np.int64))
                size.append(np.full(len(prefix), len(h), np.int32))
                asked.append((np.arange(len(prefix), dtype=np.int32) << _PLACE_BITS) | np.int32(matches))
            if tokens:
                cols = [pa.array(np.concatenate(x)) for x in (tokens, cls, size, asked)]
                yield pa.RecordBatch.from_arrays(cols, ["token", "cls", "n", "place"])

    return docs.mapInArrow(tidy(run), _POSTINGS)


def _live(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Postings whose token another class of a near enough size has too, a class once a list.

    Lists come sorted by size, so a member has such a partner if one of its neighbours is near enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _POSTINGS.split(", ")]
        kinds = (np.int64, np.int64, np.int32, np.int32)
        held, met = [np.empty(0, k) for k in kinds], False  # the last row so far, and whether the one before it is near enough

        def rows(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(k)]) for i, (h, k) in enumerate(zip(held, kinds, strict=True))]
            fresh = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            cols = [x[fresh] for x in cols]
            token, n = cols[0], cols[2].astype(np.int64)
            near = (token[1:] == token[:-1]) & (n[:-1] * den >= n[1:] * num)
            live = np.concatenate([near, [False]]) | np.concatenate([[met], near])
            held, met = [x[-1:] for x in cols], bool(live[-1])
            live[-1] = False
            if live.any():
                yield rows(cols, live)
        if met:
            yield rows(held, np.ones(1, bool))

    return postings.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(run, _POSTINGS)


def _stars(lists: DataFrame, info: DataFrame, turns: list[int], num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of list members and heads of their lists: at most as many a member as a list has heads.

    Class names are hashes, so the least of them under a turn (an exclusive or) is a random member.
    One more head, the centre, is the member whose prefix has the fewest shingles that nobody shares: what a group was copied from.
    """
    dead = F.least(F.col("n") - F.ceil(F.col("n") * num / den) + F.col("matches") - F.col("live"), F.lit(1023)).cast("long")
    rows = lists.join(info.select("cls", F.when(dead < 0, 0).otherwise(dead).alias("dead")), "cls")
    heads = [F.min(F.col("cls").bitwiseXOR(F.lit(t))).bitwiseXOR(F.lit(t)).alias(f"h{i}") for i, t in enumerate(turns)]
    # The ten low bits of the name make room for the count; the rest is joined back as it is.
    middle = F.min(F.shiftleft("dead", 53).bitwiseOR(F.shiftrightunsigned("cls", 10))).bitwiseAND(F.lit((1 << 53) - 1)).alias("middle")
    of_list = rows.groupBy("token").agg(middle, *heads)
    whole = [F.struct(F.lit(False).alias("cut"), F.col(f"h{i}").alias("head")) for i in range(len(turns))]
    names = F.array_distinct(F.array(*whole, F.struct(F.lit(True).alias("cut"), F.col("middle").alias("head"))))
    counted = lists.join(of_list, "token").select("cls", F.explode(names).alias("h")).groupBy("cls", "h").agg(F.count(F.lit(1)).alias("k"))
    one, two = (info.select(F.col("cls").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "matches", *_PARITY)]) for x in "ab")
    near = counted.where("not h.cut").select(F.col("cls").alias("a"), F.col("h.head").alias("b"), "k").join(two, "b")
    centred = counted.where("h.cut").select(F.col("cls").alias("a"), F.col("h.head").alias("head"), "k").join(two.withColumn("head", F.shiftrightunsigned("b", 10)), "head").drop("head")
    both = near.unionByName(centred).join(one, "a")
    kept = both.where((F.col("a") != F.col("b")) & (F.col("k") >= F.least("a_matches", "b_matches")) & _may("a", "b", num, den))
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _enough(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) and len(b) else 0
    return den * shared >= num * (len(a) + len(b) - shared)


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough. The sets are made again from a row of each class."""
    row = lambda x: classes.select(F.col("cls").alias(x), F.col("row").alias(f"{x}_row"))
    named = cut(pairs.join(row("a"), "a").join(row("b"), "b"))
    del pairs
    release(docs.sparkSession)
    wanted = named.select("a_row").union(named.select("b_row")).distinct()
    sent = key_filter(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = sent.value if sent is not None else None
        for b in batches:
            key, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            at = np.flatnonzero(hits(key)) if hits is not None else np.arange(b.num_rows)
            if not len(at):
                continue
            raw = []
            for i in at.tolist():
                h = shingle_hashes(lower_ascii(texts[i].as_py()), shingle)
                raw.append(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())  # the upper 48 bits
            yield pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), pa.array(raw, pa.binary())], ["row", "set"])

    def unpack(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return wide.view(np.uint64).ravel()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_enough(unpack(x.as_py()), unpack(y.as_py()), num, den) for x, y in zip(b.column(2), b.column(3), strict=True)]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    held = docs.select("row", "text").mapInArrow(sets, "row long, set binary")
    with_a = named.join(held.select(F.col("row").alias("a_row"), F.col("set").alias("set_a")), "a_row")
    with_b = with_a.join(held.select(F.col("row").alias("b_row"), F.col("set").alias("set_b")), "b_row")
    return cut(with_b.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long").distinct())


def _useful(lists: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Postings (token, cls, n, matches, group, at) of lists with members of different groups, that can help any pair.

    For a partner of m shingles, overlap is at least num * (n + m) / (num + den), and of the first n - overlap + l
    shingles l are shared. So a shingle further back serves for small partners only, and often for none in its list.
    """
    open_ = lists.join(info.select("cls", "n", "matches", "group"), "cls")
    of_list = open_.groupBy("token").agg(F.min("n").alias("least"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi")
    fits = (F.col("n") - F.col("at") - 1 + F.col("matches")) * (num + den) >= (F.col("n") + F.col("least")) * num
    kept = open_.join(of_list.select("token", "least"), "token").where(fits).drop("least")
    return kept.join(info.select("cls", *_PARITY), "cls")


def _met(useful: DataFrame, num: int, den: int) -> DataFrame:
    """A row for each prefix shingle that two classes of different groups share, if they can be similar at all."""
    side = lambda x: useful.select("token", F.col("cls").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "matches", "group", "at", *_PARITY)])
    spare = F.least("a_matches", "b_matches") - F.ceil((F.col("a_n") + F.col("b_n")) * num / (num + den))
    early = (F.col("a_at") < F.col("a_n") + spare) & (F.col("b_at") < F.col("b_n") + spare)
    return side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group")) & early & _may("a", "b", num, den))


def _across(useful: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of classes in different groups that share as many prefix shingles as either asks for."""
    counted = _met(useful, num, den).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first(F.least("a_matches", "b_matches")).alias("asked"))
    return counted.where("k >= asked").select("a", "b")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``similarity`` is a fraction: sets link if den * intersection >= num * union. Texts are lower-cased
    in A-Z; words are what ASCII white space leaves. A text of fewer words than a shingle is one
    shingle; a null text or one without words is an empty set, linked with nothing. A component is
    named by its smallest doc_id. Repeated rows stay, each with its own result. Rows without an id link like
    others and take their component's name, which is null if no row of it has an id. An empty table gives an empty result.
    """
    num, den = similarity
    spark = df.sparkSession
    prepare(spark)
    text = F.col(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"))
    scan = cut(_scan(docs, shingle))
    rows = scan.where("slice is null").select("doc_id", "cls", "n")
    classes = scan.where("cls is not null").groupBy("cls").agg(F.min("row").alias("row"), *[F.first(m).alias(m) for m in _PARITY])
    levels = spark.sparkContext.broadcast(_levels(scan))
    release(spark)
    live = cut(_live(_postings(docs, levels, shingle, num, den), num, den))
    release(spark)

    sizes = live.groupBy("cls").agg(F.count(F.lit(1)).alias("live"), F.first("n").alias("n"), F.first(F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).alias("matches"))
    info = cut(sizes.join(classes, "cls"))
    lists = live.select("token", "cls", F.shiftright("place", _PLACE_BITS).alias("at"))
    # Random members by turns of the 63-bit names.
    turns = [(0x2545F4914F6CDD1D * (i + 1)) & ((1 << 63) - 1) for i in range(HEADS)]
    near = _verified(docs, _stars(lists, info, turns, num, den), info, shingle, num, den)
    release(spark)
    groups = components(near).select(F.col("id").alias("cls"), F.col("component").alias("grp"))
    info = cut(info.join(groups, "cls", "left").withColumn("group", F.coalesce("grp", "cls")).drop("grp", "live"))
    useful = cut(_useful(lists, info, num, den))
    release(spark)
    more = _verified(docs, _across(useful, num, den), info, shingle, num, den)
    # Groups are vertices now; what no link joins stays as it is.
    of = lambda x: info.select(F.col("cls").alias(x), F.col("group").alias(f"{x}_group"))
    named = components(more.join(of("a"), "a").join(of("b"), "b"), "a_group", "b_group").select(F.col("id").alias("group"), "component")
    of_class = info.join(named, "group", "left").select("cls", F.coalesce("component", "group").alias("group"))
    linked = cut(rows.join(of_class, "cls", "left").select("doc_id", "n", F.coalesce("group", "cls").alias("group")))
    least = linked.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = linked.join(least, "group", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

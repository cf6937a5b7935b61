"""Line dedup by a segment-partition edit join, in DataFrame functions only.

How many edits k two near lines may be apart follows from the length of the shorter one
(``EDITS``). Lines are compared within classes of similar length, each of one k. A class cuts
its lines into k + 1 segments of one width, the first half counted from the line's start and
the rest from its end. Of k edits, i at most lie before some untouched segment i and k - i at
most behind it, so that segment stands in the other line moved by no more than the smaller of
the two. A line posts its segments under (class, segment number, content) and probes with its
substrings moved so far: 2, 5, 8 or 13 keys for one to four edits, the unmoved ones being the
postings. A line within k of the next class's lower end takes part in both.

(1) Keys are grouped with a bounded state to find those that a posting of one line shares with
another line. (2) Lines with such keys are compared with the earliest line of each of their
keys, which settles most members of a family in linear work. (3) Lines that this leaves are compared
with every earlier line of their keys that a bound by parity maps of character pairs admits.
Candidates are verified by the bit-parallel edit distance, banded: a window of 2k + 1 bits slides
along the diagonal, one character a step.

A line goes if the same line came before, or a near one came before
(whether or not that one stays), in the order of (doc_id, text's hash, line number).
Lines of nothing but spaces, tabs and the like stay. Lines shorter than the first length in ``EDITS`` are allowed no edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: (characters of the shorter line from which it holds, edits), by length.
EDITS = ((8, 1), (24, 2), (200, 3), (400, 4))
#: A filter that goes before a shuffle has so many bits for each key, and log2 of its bits is in this range:
#: at most 2^20 rows of 64 bits, so it may be broadcast. Fuller ones let more rows through.
FILTER_RATIO, FILTER_BITS = 64, (16, 26)

#: Far pairs are looked for in so many times the most edits of characters at both ends of where two lines differ.
END = 4

Edits = tuple[tuple[int, int], ...]


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: what stands in a lambda is computed for each element."""
    return F.transform(F.array(value), f)[0]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _allowed(n: Column, edits: Edits) -> Column:
    """The edits allowed for a shorter line of n characters."""
    out = F.lit(0)
    for low, most in edits:
        out = F.when(n >= low, most).otherwise(out)
    return out


def _class(n: Column, edits: Edits) -> Column:
    """The least length of the class of lines of n characters: n by its three leading bits, and not under the last step of ``edits``.

    Classes are as wide as the most edits, but for those that a step cuts.
    """
    least = (max(k for _, k in edits) - 1).bit_length()
    step = F.greatest(F.floor(F.log2(n)).cast("int") - 2, F.lit(least))
    at = F.lit(edits[0][0])
    for low, _ in edits[1:]:
        at = F.when(n >= low, low).otherwise(at)
    return F.greatest(F.call_function("shiftleft", F.call_function("shiftright", n, step), step), at.cast("long"))


def _posts(lines: DataFrame, edits: Edits) -> DataFrame:
    """(key, h, id, own, i) of each line, its postings (own) and its probes, and the line and its class."""
    most = max(k for _, k in edits)
    n = F.col("n")
    # A partner may be up to k shorter, in the class below.
    furthest = F.lit(0)
    for j in range(1, most + 1):
        furthest = F.when(F.lit(j) <= _allowed(n - j, edits), j).otherwise(furthest)
    steps = [n, n - furthest]
    if any(low - before < 2 * most for (before, _), (low, _) in zip(edits, edits[1:], strict=False)) or any(low % (1 << (most - 1).bit_length()) for low, _ in edits):
        steps = [n, *(F.when(F.lit(j) <= _allowed(n - j, edits), n - j) for j in range(1, most + 1))]  # narrow classes: there may be more than two
    named = [f"_t_class{j}" for j in range(len(steps))]
    classes = F.array_distinct(F.array(*named)) if len(named) > 2 else F.when(F.col(named[0]) == F.col(named[-1]), F.array(named[0])).otherwise(F.array(*named))
    sized = lines.select("h", "id", "line", F.char_length("line").cast("long").alias("n"))
    classed = sized.select("h", "id", "line", "n", *[_class(x, edits).alias(c) for x, c in zip(steps, named, strict=True)])
    each = classed.select("h", "id", "line", "n", F.explode(classes).alias("low"))
    held = each.where((F.col("low") >= edits[0][0])).withColumn("k", _allowed(F.col("low"), edits)).withColumn("width", _width())
    # Where every character is one byte, substrings of the bytes are found without counting characters; their hashes are the same.
    held = held.withColumn("bytes", F.when(F.octet_length("line") == n, F.col("line").cast("binary")))
    moves = None
    for k in sorted({k for _, k in edits}):
        rows = [(i, d, *((False, i) if 2 * i <= k else (True, i - k - 1))) for i in range(k + 1) for d in range(-min(i, k - i), min(i, k - i) + 1)]
        own = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(back).alias("back"), F.lit(times).alias("times")) for i, d, back, times in rows])
        moves = F.when(F.col("k") == k, own) if moves is None else moves.when(F.col("k") == k, own)
    every = held.select("h", "id", "line", "n", "low", "k", "width", "bytes", F.inline(moves))
    # As _start has it: segments of the first half count from the line's start, the others from its end.
    start = F.when(F.col("back"), n).otherwise(0) + F.col("times") * F.col("width") + F.col("d")
    placed = every.where((start >= 0) & (start + F.col("width") <= n))
    first, size = (start + 1).cast("int"), F.col("width").cast("int")
    key = F.when(F.col("bytes").isNull(), F.xxhash64("low", "i", F.col("line").substr(first, size))).otherwise(F.xxhash64("low", "i", F.substring("bytes", first, size)))
    return placed.select(key.alias("key"), "h", "id", (F.col("d") == 0).alias("own"), "i", "line", "n", "low", "k")


def _width() -> Column:
    return F.call_function("div", F.col("low"), F.col("k") + 1)


def _start(i: Column) -> Column:
    """Where segment i begins: the first half counts from the line's start, the rest from its end."""
    return F.when(2 * i <= F.col("k"), i * _width()).otherwise(F.col("n") - (F.col("k") + 1 - i) * _width())


def _key(i: Column, at: Column) -> Column:
    return F.xxhash64(F.col("low"), i, F.col("line").substr((at + 1).cast("int"), _width().cast("int")))


def _filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Bits of hashed keys, 64 a row, and log2 of their number."""
    n = keys.count()
    bits = min(max((n * FILTER_RATIO).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.call_function("shiftright", at, F.lit(6))
    return cut(keys.groupBy(word.alias("_t_word")).agg(F.bit_or(_bit(at.bitwiseAND(F.lit(63)))).alias("_t_bits"))), bits


def _only(df: DataFrame, column: str, held: tuple[DataFrame, int], how: str = "left_semi") -> DataFrame:
    """Rows whose hashed ``column`` passes the filter, without a shuffle. It lets some others through."""
    words, bits = held
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    hit = F.call_function("shiftright", F.col("_t_bits"), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return df.join(F.broadcast(words), (F.call_function("shiftright", at, F.lit(6)) == F.col("_t_word")) & hit, how)


def _parity(line: Column) -> Column:
    """For 128 buckets of pairs of neighbouring characters whether the line has an odd number of them."""
    def maps(pairs: Column) -> Column:
        # shiftleft takes the amount by its six lowest bits; the seventh says which map.
        every = F.aggregate(pairs, none, lambda held, x: held.bitwiseXOR(F.call_function("shiftleft", one, x)))
        upper = F.aggregate(pairs, none, lambda held, x: F.when(x.bitwiseAND(F.lit(64)) == 0, held).otherwise(held.bitwiseXOR(F.call_function("shiftleft", one, x))))
        return _with(F.struct(every.alias("every"), upper.alias("upper")), lambda m: F.struct(m["every"].bitwiseXOR(m["upper"]).alias("a"), m["upper"].alias("b")))

    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    pairs = _with(F.split(line, ""), lambda chars: F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda c, d: F.hash(c, d)))
    return _with(pairs, maps)


def _may(a: str, b: str, edits: Edits) -> Column:
    """Whether two lines can be near: an edit turns the parity of four pairs at most, and lengths differ by one at most."""
    k = _allowed(F.least(f"{a}_n", f"{b}_n"), edits)
    turned = sum((F.bit_count(F.col(f"{a}_p.{x}").bitwiseXOR(F.col(f"{b}_p.{x}"))) for x in "ab"), F.lit(0))
    return (F.abs(F.col(f"{a}_n") - F.col(f"{b}_n")) <= k) & (turned <= 4 * k)


def _core(s: Column, t: Column, most: int) -> Column:
    """Both texts (a, b) without what they begin and end with alike, but for ``most`` characters of it: their distance is the same."""

    def alike(least: Column, at: Callable[[Column, Column], Column], other: Callable[[Column, Column], Column]) -> Column:
        steps = F.array(*[F.lit(1 << e) for e in range(12, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda have, z: have + F.when((have + z <= least) & (at(have, z) == other(have, z)), z).otherwise(0))

    def cores(x: Column) -> Column:
        a, b, m = x["a"], x["b"], F.least(x["m"], x["n"])
        front = alike(m, lambda have, z: a.substr(have + 1, z), lambda have, z: b.substr(have + 1, z))

        def inner(p: Column) -> Column:
            back = alike(m - p, lambda have, z: a.substr(x["m"] - have - z + 1, z), lambda have, z: b.substr(x["n"] - have - z + 1, z))
            return _with(back, lambda q: outer(F.greatest(p - most, F.lit(0)), F.greatest(q - most, F.lit(0))))

        def outer(p: Column, q: Column) -> Column:
            return F.struct(a.substr(p + 1, x["m"] - p - q).alias("a"), b.substr(p + 1, x["n"] - p - q).alias("b"))

        return _with(front, inner)

    return _with(F.struct(s.alias("a"), t.alias("b"), F.char_length(s).alias("m"), F.char_length(t).alias("n")), cores)


def distance(s: Column, t: Column, most: int) -> Column:
    """Edit distance of two texts of ``most`` characters or more, exact up to ``most`` and more than that otherwise.

    Bit b of a word is the cell b - most under the diagonal. With each character of t the window moves down
    and right by one: ``vp`` and ``vn`` mark where the cell is one more or one less than the one above it.
    The distance is followed along the window's lowest cell and, from the end of s on, along the last row.
    Long texts are first met from both ends: the least distance of the ``END * most`` characters that t begins with to any
    beginning of s, and the same for the ends, are together no more than the distance, so most far pairs end there.
    """
    width = 2 * most + 1
    mask = F.lit((1 << width) - 1).cast("long")
    no = lambda x: F.bitwise_not(x).bitwiseAND(mask)
    long_ = lambda v: F.lit(v).cast("long")
    begin = F.struct(long_(((1 << (most + 1)) - 1) << most).alias("vp"), long_(0).alias("vn"), long_(most).alias("d"), F.lit(0).alias("j"))

    def step(held: Column, c: Column, chars: Column, size: Column) -> Column:
        vp, vn, j = held["vp"], held["vn"], held["j"] + 1
        same = None
        for b in range(width):
            one = F.when(F.get(chars, j - most + b - 1) == c, long_(1 << b)).otherwise(long_(0))
            same = one if same is None else same.bitwiseOR(one)
        return _with(same, lambda x: after(held, x, vp, vn, j, size))

    def after(held: Column, same: Column, vp: Column, vn: Column, j: Column, size: Column) -> Column:
        d0 = ((same.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(same).bitwiseOR(vn).bitwiseAND(mask)
        return _with(d0, lambda x: moved(held, x, vp, vn, j, size))

    def moved(held: Column, d0: Column, vp: Column, vn: Column, j: Column, size: Column) -> Column:
        hp, hn = vn.bitwiseOR(no(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        row = size - j + most  # the last row's bit
        at = lambda x: F.call_function("shiftright", x, row).bitwiseAND(long_(1))
        d = held["d"] + F.when(row >= width - 1, 1 - F.shiftright(d0, width - 1)).when(row < 0, long_(0)).otherwise(at(hp) - at(hn))
        return F.struct(hn.bitwiseOR(no(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), d.alias("d"), j.alias("j"))

    def walk(given: Column, finish: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.split(given["b"], ""), begin, lambda held, c: step(held, c, given["chars"], given["size"]), finish)

    def run(core: Column) -> Column:
        return _with(F.struct(F.split(core["a"], "").alias("chars"), F.char_length(core["a"]).alias("size"), core["b"].alias("b")), lambda given: walk(given, lambda x: x["d"]))

    end = END * most

    def least(x: Column) -> Column:
        over = [F.bit_count(F.shiftright(x["vp"], b + 1)) - F.bit_count(F.shiftright(x["vn"], b + 1)) for b in range(width)]
        return x["d"].cast("int") - F.greatest(*over)

    def begun(a: Column, b: Column) -> Column:
        # The window ends within these characters of a, so its last row is never met.
        given = F.struct(F.split(a, "").alias("chars"), F.lit(end + most).alias("size"), b.alias("b"))
        return _with(given, lambda x: walk(x, least))

    def ends(core: Column) -> Column:
        a, b = core["a"], core["b"]
        front = begun(a.substr(F.lit(1), F.lit(end + most)), b.substr(F.lit(1), F.lit(end)))
        back = begun(F.reverse(F.right(a, F.lit(end + most))), F.reverse(F.right(b, F.lit(end))))
        return F.when(F.least(F.char_length(a), F.char_length(b)) < 2 * end + most, False).otherwise(front + back > most)

    def both(core: Column) -> Column:
        return F.when(ends(core), F.lit(most + 1).cast("long")).otherwise(run(core))

    return F.when(F.abs(F.char_length(t) - F.char_length(s)) > most, most + 1).otherwise(_with(_core(s, t, most), both))


def _lines(df: DataFrame) -> DataFrame:
    return df.select("_t_key", "_t_id", F.posexplode(F.split("_t_text", "\n", -1)).alias("pos", "line")).select(
        "_t_key", "_t_id", "pos", "line",
        F.xxhash64("line").alias("h"),
        (F.shiftleft(F.crc32(F.col("line").cast("binary")), 31).bitwiseXOR(F.char_length("line").cast("long"))).alias("g"),
        (F.ltrim("line", F.lit(" \t\r\x0b\x0c")) == "").alias("blank"),
    )


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"_t_id": F.col(id_col).cast("long"), "_t_text": text, "_t_key": F.xxhash64(F.col(id_col), text)})


def _later(pairs: DataFrame, texts: DataFrame, edits: Edits) -> DataFrame:
    """(h, g) of the later line of each pair (ah, bh) of near lines."""
    most = max(k for _, k in edits)
    side = lambda x: texts.select(*[F.col(c).alias(f"{x}{c}") for c in ("h", "g")], *[F.col(c).alias(f"{x}_{c}") for c in ("n", "first", "line")])
    both = pairs.join(side("a"), "ah").join(side("b"), "bh")
    near = both.where(distance(F.col("a_line"), F.col("b_line"), most) <= _allowed(F.least("a_n", "b_n"), edits))
    a_later = F.col("a_first") > F.col("b_first")
    return near.select(F.when(a_later, F.col("ah")).otherwise(F.col("bh")).alias("h"), F.when(a_later, F.col("ag")).otherwise(F.col("bg")).alias("g")).distinct()


def _near(black: DataFrame, groups: DataFrame, edits: Edits) -> DataFrame:
    """(h, g) of lines that a near line came before."""
    long_ = black.where(F.char_length("line") >= edits[0][0]).select("h", F.col("_t_id").alias("id"), "line", "g")
    posts = _posts(long_, edits)
    live = cut(posts.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).where("lo < hi and own").select("key"))
    # A key tells its segment number and class.
    some = _only(posts, "key", _filter(live, "key")).groupBy("key", "h").agg(F.min("id").alias("id"), F.max("own").alias("own"), F.min("i").alias("i"), F.min("low").alias("low"))
    met = cut(some.join(live, "key", "left_semi"))
    # The text of the lines that may be near another one, once each.
    held = _only(long_, "h", _filter(met.select("h").distinct(), "h")).groupBy("h", "g").agg(F.first("line").alias("line"))
    texts = cut(held.join(groups.select("h", "g", "first"), ["h", "g"]).select("h", "g", "first", "line", F.char_length("line").cast("long").alias("n"), _parity(F.col("line")).alias("p")))
    segments = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: _key(i, _start(i)))
    known = met.join(texts.select("h", "n", "p", "line"), "h").withColumn("k", _allowed(F.col("low"), edits)).withColumn("segments", segments).drop("line")

    # Every line against the earliest posting line of its keys, and posting lines against the earliest line.
    earliest = F.struct("id", "h")
    heads = met.groupBy("key").agg(F.min(F.when(F.col("own"), earliest))["h"].alias("x"), F.min(earliest)["h"].alias("y"))
    headed = known.join(heads, "key")
    asked = headed.select("h", "n", "p", F.explode(F.array_distinct(F.array("x", F.when(F.col("own"), F.col("y"))))).alias("head")).where("h != head")
    asked = asked.select(F.least("h", "head").alias("ah"), F.greatest("h", "head").alias("bh")).distinct()
    brief = lambda x: texts.select(F.col("h").alias(f"{x}h"), F.col("n").alias(f"{x}_n"), F.col("p").alias(f"{x}_p"))
    first = asked.join(brief("a"), "ah").join(brief("b"), "bh").where(_may("a", "b", edits)).select("ah", "bh")
    settled = cut(_later(first, texts, edits))

    # What is not settled, against every line of its keys that came before and can be near.
    # Heads have been compared with every line that they can be near at their keys.
    others = headed.where(~F.col("h").eqNullSafe(F.col("x")) & (F.col("h") != F.col("y")))
    side = lambda d, x: d.select("key", *[F.col(c).alias(f"{x}{c}") for c in ("h", "id", "own", "i", "segments")], *[F.col(c).alias(f"{x}_{c}") for c in ("n", "p")])
    rest = others.join(settled.select("h"), "h", "left_anti")
    before = (F.col("bid") <= F.col("aid")) | F.col("bid").isNull()
    # Two lines with equal segments in place meet at the first of them only.
    equal = F.array_position(F.zip_with("asegments", "bsegments", lambda x, y: x == y), True)
    once = (equal == 0) | ((equal == F.col("ai") + 1) & F.col("aown") & F.col("bown"))
    pairs = side(rest, "a").join(side(others, "b"), "key").where((F.col("ah") != F.col("bh")) & (F.col("aown") | F.col("bown")) & before & _may("a", "b", edits) & once)
    more = _later(pairs.select(F.least("ah", "bh").alias("ah"), F.greatest("ah", "bh").alias("bh")).distinct(), texts, edits)
    return settled.union(more).distinct()


def _repeated(lines: DataFrame, edits: Edits) -> DataFrame:
    """(h, g, first, near) of lines that have copies or a near line before them."""
    black = lines.where("not blank")
    groups = cut(black.groupBy("h", "g").agg(F.min(F.struct("_t_id", "_t_key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")))
    near = _near(black, groups, edits).withColumn("near", F.lit(True))
    marked = groups.join(near, ["h", "g"], "left").where("n > 1 or near")
    return marked.select("h", "g", F.struct(F.col("first._t_key").alias("key"), F.col("first.pos").alias("pos")).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Edits = EDITS) -> DataFrame:
    """Adds _t_gone: the numbers of the lines of the row's text that go, from 0; null where none goes.

    ``edits`` must not allow more edits than its first length has characters.
    """
    if edits[0][0] < max(k for _, k in edits):
        raise ValueError("lines must be longer than the edits they are allowed")
    prepare(df.sparkSession)
    keyed = _keyed(df, id_col, text_col)
    repeated = cut(_repeated(_lines(keyed), edits))
    lines = _lines(keyed).where("not blank").select("_t_key", "pos", "h", "g")
    gone = F.col("near") | (F.col("first.key") != F.col("_t_key")) | (F.col("first.pos") != F.col("pos"))
    flagged = _only(lines, "h", _filter(repeated, "h")).join(repeated, ["h", "g"]).where(gone)
    flags = cut(flagged.groupBy("_t_key").agg(F.collect_set("pos").alias("_t_gone")))
    held = _filter(flags, "_t_key")
    # Only texts that may lose lines are shuffled.
    hit = _only(keyed, "_t_key", held).join(flags, "_t_key", "left")
    rest = _only(keyed, "_t_key", held, "left_anti")
    return hit.unionByName(rest, allowMissingColumns=True)


def _kept(text: Column) -> Column:

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_t_gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.when(F.col("_t_gone").isNull(), text).otherwise(_with(F.split(text, "\n", -1), left))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Edits = EDITS) -> DataFrame:
    """Every row with repeated lines taken out of its text; other columns stay.

    Lines end with a line feed. A null text stays null, an empty one empty. Rows alike in id and text
    count as one and keep the same lines. Columns of the table must not begin with _t_. An empty table gives an empty result.
    """
    marked = mark(df, id_col, text_col, edits)
    return marked.withColumn(text_col, _kept(F.col(text_col))).select(*df.columns)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Edits = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row; a null or empty text is one empty line."""
    marked = mark(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", edits)
    removed = F.when(F.col("_t_gone").isNull(), 0).otherwise(F.size("_t_gone"))
    return marked.select("doc_id", F.size(F.split("_t_text", "\n", -1)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), _kept(F.col("text")).alias("text"))

"""The operators against brute force on small tables with nulls, empty texts, copies and extra columns."""

import hashlib
import itertools
import random
import time

from pyspark.sql import functions as F

from tessera.llm import html_text, jaccard, line_dedup, packing, quality, shard, suffix_dedup
from tessera.llm.bpe import ByteBPE
from tessera.llm.common import cut
from tessera.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary

KIND = "doc_id bigint, text string, component_id string, key int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], KIND)


def words(seed, n, pool=400):
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


def near_texts():
    base = words(1, 120)
    out = [None, "", " \t", "one", "ONE", " ".join(base), " ".join(base).upper(), " ".join(words(2, 80))]
    for k in range(12):
        own = list(base)
        for j in random.Random(k).sample(range(120), k):
            own[j] = f"x{k}_{j}"
        out.append(" ".join(own))
    return out


def test_jaccard_join(spark):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table(spark, texts), shingle=3, similarity=(80, 100)).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(3, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def test_suffix_dedup(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdé ") for _ in range(90))
    texts = [None, "", "aaaa" * 40, passage + "1", "2" + passage + "zz", "xyz" * 5, passage[:45] + "é" + passage, passage[:41]]
    size = 40
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for x in raw:
        for i in range(len(x) - size + 1):
            seen[x[i : i + size]] = seen.get(x[i : i + size], 0) + 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(table(spark, texts), length=size).collect()}
    for k, x in enumerate(raw):
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        assert got[k] == (len(x), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest())


def test_suffix_dedup_at_the_length_of_its_contract(spark):
    r = random.Random(11)
    some = lambda n: "".join(r.choice("abcdefghij") + " " * (k % 6 == 5) for k in range(n))[:n]
    short, long = some(399), some(400)
    assert len(short.split()) > 50
    texts = ["A" + short + "B", "C" + short + "D", "E" + long + "F", some(50) + "G" + long]
    got = {x.doc_id: x for x in suffix_dedup.digests(table(spark, texts)).collect()}
    assert [got[k].n_removed for k in range(4)] == [0, 0, 400, 400]
    assert [got[k].text for k in range(4)] == [*texts[:2], "EF", texts[3][:51]]


def test_line_dedup(spark):
    line = "a line that is long enough to be compared"
    texts = [line + "\nfirst", "second\n" + line, line + "!", None, "", "first\n\n\nlast", "a line that is long enough t be compared"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.report(table(spark, texts)).collect()}
    assert got == {0: (2, 0, line + "\nfirst"), 1: (2, 1, "second"), 2: (1, 1, ""), 3: (1, 0, None), 4: (1, 0, ""), 5: (4, 1, "\n\nlast"), 6: (1, 1, "")}


def changed(line, r, n):
    """The line with n characters put in, taken out or put in another's place."""
    out = list(line)
    for _ in range(n):
        k, what = r.randrange(len(out)), r.randrange(3)
        out[k : k + (what > 0)] = ["#"] * (what < 2)
    return "".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_by_length(spark):
    r, texts = random.Random(6), []
    for k, n in enumerate((5, 9, 23, 24, 25, 60, 198, 202, 300, 398, 402, 500)):
        line = " ".join(words(k, 120))[:n]
        texts += [line, *(changed(line, r, e) for e in (1, 2, 2, 3, 3, 4, 4, 5, 6))]
    r.shuffle(texts)

    def near(a, b):
        n = min(len(a), len(b))
        return distance(a, b) <= (4 if n >= 400 else 3 if n >= 200 else 2 if n >= 24 else 1 if n >= 8 else 0)

    gone = {i: any(texts[j] == texts[i] or near(texts[i], texts[j]) for j in range(i)) for i in range(len(texts))}
    got = {x.doc_id: x.n_removed for x in line_dedup.report(table(spark, texts)).collect()}
    assert got == {i: int(x and texts[i].strip() != "") for i, x in gone.items()}
    assert sum(gone.values()) > 25


def test_line_distance(spark):
    r, rows = random.Random(8), []
    for _ in range(400):
        s = "".join(r.choice("abcé") for _ in range(r.randrange(8, 60)))
        rows.append((s, changed(s, r, r.randrange(7)) or s))
    for i in range(300):  # differences far apart, some of them in clusters, meet the test from both ends
        s = "".join(r.choice("abcé") for _ in range(r.randrange(60, 160)))
        n, inner = i % 5, r.randrange(8, len(s) - 8)
        rows.append((s, s[:4] + "x" * n + s[4:-3] + "yz"[: i % 3] + s[-3:] if i % 2 else changed(s[:inner], r, r.randrange(5)) + changed(s[inner:], r, r.randrange(5))))
    rows = [(s, t) for s, t in rows if len(t) >= 4]
    got = spark.createDataFrame(rows, "s string, t string").select("s", "t", line_dedup.distance(F.col("s"), F.col("t"), 4).alias("d")).collect()
    assert all(min(x.d, 5) == min(distance(x.s, x.t), 5) for x in got) and len(got) > 300


def test_line_dedup_of_short_lines(spark):
    texts = ["All rights reserved", "All right reserved", "ab", "ac", "All  right reserved"]
    assert [r.n_removed for r in line_dedup.report(table(spark, texts)).sort("doc_id").collect()] == [0, 1, 0, 0, 1]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = vocabulary(BYTE_VOCABULARY)
    own, library = ByteBPE(path), Tokenizer.from_file(path)
    r = random.Random(4)
    texts = ["", "don't  stop\n\n now<|endoftext|>x", *("".join(r.choice("abcdeinrst' \n\x1cé漢🎈") for _ in range(r.randrange(60))) for _ in range(300))]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    texts = [None, "", "Some words, ÉTÉ Σς!", " ".join(words(5, 4000)), *(" ".join(words(k, 30 + k)) for k in range(40))]
    got = packing.pack(packing.pieces(table(spark, texts), vocabulary(WORD_VOCABULARY))).collect()
    size, used = {}, {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    assert size == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_sharding(spark):
    rows = shard.assign(table(spark, ["x"] * 500 + [None])).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows} == {2, 1}


def test_quality_and_html():
    good, bad = [" ".join(words(k, 50)) for k in range(40)], [" ".join(w + "***" for w in words(k, 50)) for k in range(40)]
    scorer = quality.Scorer(*quality.train(good + bad, [1] * 40 + [0] * 40))
    assert scorer.score(" ".join(words(99, 60))) > 0.5 > scorer.score(" ".join(w + "***" for w in words(98, 60)))
    assert 0 <= scorer.score(None) <= 1
    page = '<html><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>T &amp; U</h1><p>a  b<br>c</p></article><footer>f</footer>'
    assert html_text.main_text(page) == "T & U\na b c"
    assert html_text.main_text(None) == ""


def test_html_article_in_a_plain_div():
    amid = ['<div class="ad">x</div>', "<form><input><p>x</p></form>", "<aside><p>x</p></aside>", '<p class="notice">x</p>', '<ul class="share"><li>x</li></ul>']
    for x in amid:
        assert html_text.main_text(f"<body><div id=content><p>A one</p>{x}<p>B</p></div></body>") == "A one\nB"
        assert html_text.main_text(f"<body><p>A one</p>{x}<p>B</p>") == "A one\nB"
        assert html_text.main_text(f"<div><div><p>A one</div>{x}<section><p>B<div>C</section>{x}<p>D</div>") == "A one\nB\nC\nD"
        assert html_text.main_text(f"<div>short</div>{x}<div><p>A longer one</p>{x}<p>B</p></div>{x}<div>end</div>") == "A longer one\nB"
    assert html_text.main_text("<div>" + "".join(f"<p>{k}</p>{x}" for k, x in enumerate(amid)) + "</div></div><p>z</p>") == "0\n1\n2\n3\n4"
    assert html_text.main_text("<div>" + f"<p>part</p>{amid[0]}" * 9 + "</div><div>another region</div>") == "\n".join(["part"] * 9)
    assert html_text.main_text(f"<div><p>long text</p>{amid[0]}<article>A</article></div>") == "A"


def test_jaccard_tasks_hold_one_sketch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Docs:
        def mapInArrow(self, run, kind):
            return run

    texts = [" ".join(words(i, 300)) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts), pa.array(range(50), pa.int64())], ["doc_id", "text", "row"])
    level = np.random.default_rng(4).integers(0, 60, 1 << jaccard.SKETCH_BITS).astype(np.uint8)

    class Sent:
        value = level

    sketch = 4 << jaccard.SKETCH_BITS
    for run, rows in ((jaccard._scan(Docs(), 5), batch), (jaccard._postings(Docs(), Sent, 5, 80, 100), batch)):
        tracemalloc.start()
        got = list(run(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got and peak < 1.5 * sketch
    held = np.exp2(np.arange(256) / 4.0) - 1.0
    assert jaccard._middle(level, held) == np.median(held[level]) and jaccard._middle(level[:1001], held) == np.median(held[level[:1001]])


def test_packing_leaves_no_words_in_workers(spark):
    import zlib

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Docs:
        sparkSession = spark

        def select(self, *cols):
            return self

        def mapInArrow(self, run, kind):
            return run

    path = vocabulary(WORD_VOCABULARY)
    texts = [None, *(" ".join(words(k, 300)) for k in range(5)), "an unassigned ͸ é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in packing.pieces(Docs(), path)(iter([batch, batch])) for r in b.to_pylist()]
    library = Tokenizer.from_file(path)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    assert [(r["length"], r["ids_crc32"]) for r in got] == 2 * [(len(x), zlib.crc32(x.tobytes())) for x in ids]
    left = packing.word_tokenizer(path)
    assert not left.units and not left.pieces


def test_packing_asks_stores_and_library_once(monkeypatch):
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def get(self, key, *other):
            Counted.asked += 1
            return super().get(key, *other)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    class Library:
        texts = 0

        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            Library.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    path = vocabulary(WORD_VOCABULARY)
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    own.units, own.tokenizer = Counted(), Library(own.tokenizer)
    r = random.Random(8)
    odd = ["".join(r.choice("abét'sreΣ1²-_, \n\x1c\x85漢🎈ǅʰ<|>") for _ in range(r.randrange(80))) for _ in range(200)]
    odd += [None, "", "  ", "<|endoftext|>it's<|ENDOFTEXT|>", "''s 's'sabc ###, don't, DON'T 12,3", "a\0b"]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert [x.tolist() for x in own.batch(odd)] == expected
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)  # stores that overflow again and again
    monkeypatch.setattr(packing, "LEARN_ROWS", 3)
    assert [x.tolist() for x in own.batch(odd)] == expected
    monkeypatch.undo()
    own.forget()
    Counted.asked = Library.texts = 0
    text = " ".join(words(9, 2000, pool=50)) + " plain letters, again letters"
    ids = library.encode(text, add_special_tokens=False).ids
    assert all(x.tolist() == ids for x in own.batch([text] * 100))
    assert Counted.asked < 500  # about 53 different units, 200400 places
    assert Library.texts == 1  # not one for each word


def test_release_removes_shuffle_files(spark):
    from tessera.llm.common import cut, release

    files = lambda: sum("shuffle" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    kept = cut(spark.range(1000).repartition(3, "id"))
    assert files() > 0
    for _ in range(50):
        release(spark)
        if not files():
            break
        time.sleep(0.2)
    assert files() == 0 and kept.count() == 1000


def test_jaccard_sketches_are_sent_small():
    import zlib

    import numpy as np

    counts = np.random.default_rng(2).poisson(0.4, 1 << 16).astype(np.uint32)
    counts[:3] = 2**32 - 1, 70_000, 256
    assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()
    assert len(jaccard._packed(counts)) < 0.75 * len(zlib.compress(counts.tobytes(), 1))


def test_a_cut_gives_native_memory_of_the_driver_back(spark):
    jvm = spark.sparkContext._jvm
    native, pid = jvm.io.netty.util.internal.PlatformDependent, jvm.java.lang.ProcessHandle.current().pid()

    def held():
        return next(int(x.split()[1]) for x in open(f"/proc/{pid}/status") if x.startswith("VmRSS"))  # kB

    size, n = 100_000, 1600
    cut(spark.range(1))  # so that code is loaded
    chunks = [native.allocateMemory(size) for _ in range(n)]
    for c in chunks:
        native.setMemory(c, size, 1)
    for c in chunks[::2]:
        native.freeMemory(c)  # every other one, so that none of it lies at the end of the C library's heap
    before = held()
    cut(spark.range(1))
    after = held()
    for c in chunks[1::2]:
        native.freeMemory(c)
    assert before - after > size * n // 2 / 1024 / 2

"""Alignment, importance resampling and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from confluence.llm import align, decontaminate, importance

TEXTS = [
    None, "", " ", "a", "Hello, world!", "Hello, world!", "two  blanks\n\n\nand lines\t\ttabs", "naïve café — 東京 \U0001f600\U0001f468‍\U0001f469 ½", "<|endoftext|> and <s> <unk> </s> are plain", "under▁score", "nul\x00byte",
    " leading", "trailing ", "x" * 3000, "word " * 4000, "1234567890 3.14159 don't we'll they've", "́combining ​ zero", "ſtrange İ ß", "� replaced", "a" + " " * 12_000 + "b", "ﬁ ligature ① full　width",
]


def tables(spark, rows, names="doc_id long, text string"):
    """Rows over three partitions, with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, names)
    for clash in ("row", "n", "print", "pairs", "rank", "score", "_words", "_buckets", "n_words", "hits", "_at", "weight"):
        df = df.withColumn(clash, F.lit("clash"))
    return df.repartition(3)


def plain_alignment(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # the usual table of printable stand-ins for bytes
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out, counts, links = [], Counter(), []
    for text in texts:
        own, row = [], [0, 0, 0, ""]
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            x = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
            y = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 50 else [*__import__("itertools").accumulate(map(len, parts))]
                p, q = ends(x), ends(y)
                both = sorted(set(p) & set(q))
                groups, low = [], 0
                for cut in both:
                    groups.append(",".join(str(a[i]) for i in range(len(a)) if low < p[i] <= cut) + "|" + ",".join(str(b[i]) for i in range(len(b)) if low < q[i] <= cut) if len(a) < 3000 else None)
                    low = cut
                i = j = 0
                while i < len(a) and j < len(b):  # ranges that overlap
                    if max(p[i] - len(x[i]), q[j] - len(y[j])) < min(p[i], q[j]):
                        own.append((a[i], b[j]))
                    i, j = (i + (p[i] <= q[j]), j + (q[j] <= p[i]))
                row = [len(a), len(b), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None]
        counts.update(own)
        links.append(own)
        out.append(row)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(*row[:3], len(own), sum(counts[l] == most[l[1]] for l in own), sum(counts[l] for l in own), row[3]) for row, own in zip(out, links)]


@pytest.mark.parametrize("limit", [align.BROADCAST, 40, 0])
def test_alignment_is_that_of_common_ends(spark, monkeypatch, limit):
    """The small limits send pairs through the join; a small memo is filled anew again and again."""
    monkeypatch.setattr(align, "SUMMED", 50)
    rng = random.Random(3)
    texts = TEXTS + [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(80)) for _ in range(10)]
    want = plain_alignment(texts)
    got = {r.doc_id: tuple(r)[1:] for r in align.judged(tables(spark, list(enumerate(texts))), limit=limit).collect()}
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i][:6] == row[:6], texts[i][:60]
        assert row[6] is None or got[i][6] == row[6]
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_repeated_and_nameless_rows_and_of_nothing(spark):
    rows = [(None, "one two"), (None, "one two"), (4, "one two"), (4, "three")]
    got = Counter(tuple(r) for r in align.judged(tables(spark, rows)).collect())
    want = plain_alignment([t for _, t in rows])
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert align.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_transducer_forgets_and_refuses():
    own = align.Transducer({1: b"ab", 2: b"c", 3: b"abc"}, {1: b"a", 2: b"bc", 3: b"abd"})
    assert own.align([1, 2], [1, 2]) == ([2], [2], [1 << 16 | 1, 1 << 16 | 2, 2 << 16 | 2])
    own.memo = dict.fromkeys(range(align.MEMO + 1), 7)
    assert own.align([3], [1, 2]) == ([1], [2], [3 << 16 | 1, 3 << 16 | 2])
    for a, b in (([3], [3]), ([3], [1]), ([1], [1, 2]), ([1, 2], [1])):
        with pytest.raises(ValueError):
            own.align(a, b)


def plain_draw(docs, target, percent=10, least=20, order=1, buckets=10_000):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: word.findall((t or "").translate(lower))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    bucket = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(of(t))]
    s, t = (Counter(b for x in texts for b in bucket(x)) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        held = bucket(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in held)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(of(x))))
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    n = percent * len(may) // 100
    return Counter([(*r[:4], i + 1) for i, r in enumerate(may[:n])] + [(*r[:4], None) for r in may[n:]] + [(*r[:4], None) for r in rows if r[4] < least])


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "and", "naïve", "東京", "x1", "ÀB", "don't", "U.S."] + [f"w{i}" for i in range(300)]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200])))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2])
def test_draw_is_that_of_plain_code(spark, order):
    docs = corpus(1, 150) + [(None, "a b c"), (None, None), (7, "w1 " * 30), (7, "w1 " * 30), (7, "w1 " * 30), (None, "w1 " * 30), (900, "word " * 50_000), (901, "")]
    target = [(i, t) for i, t in corpus(2, 20)] + [(None, None), (1, "")]
    got = importance.drawn(tables(spark, docs), tables(spark, target, "item_id long, text string"), order=order)
    assert Counter(tuple(r) for r in got.collect()) == plain_draw(docs, [t for _, t in target], order=order)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"


def test_draw_from_nothing_and_without_a_target(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = corpus(4, 40)
    assert importance.drawn(empty, tables(spark, docs)).count() == 0
    assert Counter(tuple(r) for r in importance.drawn(tables(spark, docs), empty).collect()) == plain_draw(docs, [])
    text = importance.scored(spark.createDataFrame(docs, "doc_id long, text string"), [0] * 10_000)._jdf.queryExecution().toString()
    assert not re.search(r"Exchange|Generate |Python|Arrow", text)


def plain_hits(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: word.findall((t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = of(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[a : a + window]), set()).add("" if i is None else str(i))
    sizes, out = {len(x) for x in windows}, []
    for i, t in docs:
        w, hit, found = of(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own:
                    hit |= set(range(a, a + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("window,k,bits", [(10, 5, 27), (10, 10, 16), (4, 1, 16), (3, 2, 27)])
def test_every_shared_window_is_found(spark, monkeypatch, window, k, bits):
    """The texts share spans of all lengths around a window; a filter of few bits lets much pass wrongly."""
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 6)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    rng = random.Random(window * 100 + k)
    vocabulary = ["The", "of", "naïve", "東京", "x1", "ÀB"] + [f"w{i}" for i in range(60)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(60)]
    items += [(i + 100, w) for i, w in items[:20]] + [(None, some(12)), (7, some(12)), (7, some(12))]
    docs = []
    for i in range(120):
        w = some(rng.choice([0, 3, 10, 80]))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1]
            a = rng.randrange(len(own))
            at = rng.randrange(len(w) + 1)
            w[at:at] = own[a : a + rng.randint(1, 30)]
        docs.append((i, rng.choice([" ", "; ", "\n"]).join(w)))
    items = [(i, " ".join(w).upper() if rng.random() < 0.3 and all(map(str.isascii, w)) else "..".join(w)) for i, w in items] + [(500, ""), (501, None)]
    docs += [(None, docs[1][1]), (None, docs[1][1]), (3, docs[2][1]), (3, docs[2][1]), (1000, None), (1001, ""), (1002, "w1 " * 40_000 + items[3][1]), (1003, items[5][1])]
    got = decontaminate.judged(tables(spark, docs), tables(spark, items, "item_id long, text string"), window, k)
    assert Counter(tuple(r) for r in got.collect()) == plain_hits(docs, items, window)


def test_decontamination_of_and_by_nothing(spark):
    empty, docs = spark.createDataFrame([], "doc_id long, item_id long, text string"), tables(spark, [(1, "a b c"), (2, None)])
    assert decontaminate.judged(empty, empty).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert Counter(tuple(r) for r in decontaminate.judged(docs, empty).collect()) == Counter([(1, 3, 0, 0, none, False), (2, 0, 0, 0, none, False)])

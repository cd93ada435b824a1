import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from confluence.llm import bpe, fingerprint, packing, repetition, toxicity, url_filter, warc
from confluence.llm.words import Words, distinct

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b c", "x " * 60, "\x85 \x0b a\x0bb é", "a\r\na\r\na", "one two three four five " * 4, "é" * 3000]


def texts(seed, n, letters="abc"):
    rng = random.Random(seed)
    return ODD + [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["\n".join(rng.choice(["a", "b ", " ", "", "a b"]) for _ in range(9)) for _ in range(n // 4)]


def test_words_and_shingles_follow_the_definition():
    rows = texts(1, 200)
    words = Words(pa.array(rows, pa.string()))
    doc, value = distinct(*words.shingles(4))
    for i, t in enumerate(rows):
        own = [w.lower() for w in WORD.findall(t or "")]
        assert words.n_words[i] == len(own)
        assert (doc == i).sum() == (len({tuple(own[j : j + 4]) for j in range(max(1, len(own) - 3))}) if own else 0)


def test_repetition_follows_brute_force():
    rows = texts(2, 150)
    got = repetition.counts(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        spans = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        longest = max((k for a in range(len(w)) for b in range(a + 1, len(w)) for k in [next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b)]), default=0)
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(spans), longest if longest >= 5 else 0)
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")) == expected
        assert got["base_failed"][i] == (len(w) < 10 or 100 * len(spans) > 20 * len(w))


def test_long_repeats_have_their_own_limit():
    """15 % of the words in repeats: a text goes for one of 12 words, but stays for repeats of eight."""
    word = [f"w{i}" for i in range(200)]
    long = word[:136] + word[10:22]
    long += word[150:162]
    short = word[:184] + [w for a in (0, 20) for w in [*word[a : a + 8], f"x{a}"]]
    got = repetition.counts(pa.array([" ".join(long), " ".join(short), " ".join(word[:136])]))
    assert got["n_words"].tolist() == [160, 202, 136] and got["longest_repeat"].tolist() == [12, 8, 0]
    assert got["n_repeat_words"].tolist() == [24, 32, 0] and got["n_long_words"].tolist() == [24, 0, 0]
    assert got["base_failed"].tolist() == [False] * 3 and got["kept"].tolist() == [False, True, True]


def test_fingerprints_estimate_similarity():
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(600)]
    rows = [" ".join(base[:400] + [f"x{rng.randrange(9999)}" for _ in range(200)]), " ".join(base), " ".join(base), "", None, "few words"]
    digits, filled = fingerprint.codes(pa.array(rows, pa.string()))
    own = fingerprint.as_text(digits, filled)
    assert own[1] == own[2] and own[3] == own[4] == "" and len(own[0]) == len(own[5]) == fingerprint.BINS
    sets = [{tuple(r.split()[i : i + 5]) for i in range(596)} for r in rows[:2]]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    near = fingerprint.likeness(digits[:1], filled[:1], digits[1:2], filled[1:2])[0]
    assert abs(near - true) < 0.12
    assert fingerprint.likeness(digits[3:4], filled[3:4], digits[4:5], filled[4:5])[0] == 1


def test_neighbours_edit_and_wrap(spark):
    rows = [(3, "abcdefgh", 1), (1, "one two three four", 2), (2, None, 3)]
    got = {r.doc_id: r for r in fingerprint.neighbours(spark.createDataFrame(rows, "doc_id long, text string, peek int")).collect()}
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {k: r.n_chars for k, r in got.items()} == {1: 18, 2: 0, 3: 8}
    assert got[3].edited_sha256 == sha("abcdefon") and got[2].edited_sha256 == sha("") and got[1].edited_sha256 == sha("one two three ")
    assert fingerprint.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert fingerprint.neighbours(spark.createDataFrame([(7, "a b")], "doc_id long, text string")).count() == 1


def test_automaton_follows_regular_expressions():
    patterns = ["a*b", "**x/**", "*.org/**", "a?c", "", "**", "ab**cd**ef" + "g" * 70]
    rng = random.Random(4)
    rows = ["", "a/b", "aXb", "abc", "x/", "b.org/a", "c/x.org/", "ab1cd/2ef" + "g" * 70] + ["".join(rng.choice("abx/.org") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    forms = [re.compile("".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "."}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]", p))) for p in patterns]
    expected = [[bool(f.fullmatch(t)) for f in forms] for t in rows]
    assert url_filter.Automaton(patterns).matches(pa.array(rows)).tolist() == expected


def test_url_rules(spark):
    rows = [("http://A.Example.org/en/1x?q", "example.org/en/1", "block"), ("https://x.org", None, "allow"), ("http://shop.com/de/", "com/de/", "block"), (None, None, "allow"), ("mailto:x", None, "allow"), ("http://www.casino.net/", None, "block"), ("http://evil.net/a.org/", None, "allow")]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judged(df).orderBy("page_id").collect()] == [r[1:] for r in rows]


def test_canonical_urls_meet_the_globs(spark):
    """User information, default ports, escapes, empty and dot segments hide nothing; the contract's host and path stay as they are."""
    assert url_filter.canonical("u:p@www.a.net.:443", "//x/./%41b%2Dc/../%2e%2e/D/..") == "www.a.net/"
    assert url_filter.canonical("a.net:8080", "/%2541/a%2Fb") == "a.net:8080/%2541/a%2fb" and url_filter.canonical("a.net", "") == "a.net"
    rows = [
        ("http://me@ads1.a.net:80/x", "block"), ("http://ads12.a.net/x", "allow"), ("http://b.net/%77p-login.php", "block"), ("http://b.net/q/../wp-login.php?a=1", "block"), ("http://b.net/wp-login.php/x", "allow"),
        ("http://b.net//doorway-a/./page", "block"), ("http://b.net/doorway-ab/page", "allow"), ("http://b.net/tag/one/feed", "block"), ("http://b.net/tag/one/two/feed", "allow"), ("http://b.net/C%41SINO", "block"), ("http://b.net/" + "x" * 20_000 + "casino", "block"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(rows)], "page_id long, url string, host string")
    got = url_filter.judged(df).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, v) for _, v in rows] and got[0].host == "me@ads1.a.net:80"
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar)")
    duck.executemany("insert into pages values (?, ?)", [(i, u) for i, (u, _) in enumerate(rows)])
    told = duck.execute(url_filter.sql() + " order by page_id").fetchall()
    assert [tuple(r) for r in told] == [tuple(r) for r in got]
    assert url_filter.judged(df.limit(0)).count() == 0


def test_bpe_follows_the_public_encoder():
    own = bpe.Codec()
    public = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(5)
    letters = " \n\t\r\x0b\x85\xa0 \x1c" + "ab'sthé1٣ 漢!?😀"
    rows = ["", "  ", "a  b", "x\n\ny", "a \n b", "don't 're", "a" * 3000, "abé" * 900] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in rows:
        ids = own.encode(t)
        assert ids == public.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_bpe_query_rows(spark):
    """Ids and bytes by the public encoder; null, empty, very long and repeated texts, null ids, clashing columns, an empty table."""
    public = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    texts = [None, "", "hello  wörld", "hello  wörld", "a" * 200_000, " " * 50_000 + "x", "漢字 <|endoftext|> 😀"]
    df = spark.createDataFrame([(None if i == 2 else i % 5, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    plain = [public.encode_ordinary(t) if t and len(t) < 1000 else bpe.Codec().encode(t or "") for t in texts]
    expected = Counter((None if i == 2 else i % 5, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, (t, ids) in enumerate(zip(texts, plain)))
    assert Counter(tuple(r) for r in bpe.round_trip(df).collect()) == expected
    apart = bpe.decoded(bpe.encoded(df)).collect()
    assert Counter(bytes(r.data) for r in apart) == Counter((t or "").encode() for t in texts)
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_quality_rows_as_a_frame(spark):
    """Null ids and texts, clashing columns, an empty table, and words that break polynomial hashes."""
    odd = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    twin = odd.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, f"{odd} x y z q {twin} x y z q", 3)], "doc_id long, text string, n_words int")
    got = repetition.measured(df).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_repeat_words) for r in got) == [(False, 0, 0), (False, 10, 0), (True, 0, 0)]
    assert repetition.measured(df.limit(0)).count() == 0
    runs = [odd[i] for i in range(1024)]
    flipped = [twin[i] for i in range(1024)]
    measure = repetition.counts(pa.array([" ".join(runs + ["#"] + flipped)]))
    best = 0
    for shift in range(1, 2049):  # the longest common run of the text with itself moved on
        word, length = runs + ["#"] + flipped, 0
        for a, b in zip(word, word[shift:]):
            length = length + 1 if a == b else 0
            best = max(best, length)
    assert measure["longest_repeat"][0] == best


def test_toxicity_features_follow_plain_counts():
    """Dense features of single texts against counting by hand."""
    learnt = strong = np.zeros(0, np.uint64)
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    rows = ["", "you are an idiot!", "one two three four five six idiot you", "idiot a b c d e f you", "WHAT is THIS? stupid stupid", "clean words only here"]
    got = toxicity.features(pa.array(rows), learnt, strong)
    insults = [sum(w.strip("!?.").lower() in toxicity.LEXICON for w in t.split()) for t in rows]
    assert len(got) == len(rows) and np.isfinite(got).all()
    order = lambda name: np.argsort(got[:, at[name]], kind="stable")
    assert (got[:, at["insults"]] > 0).tolist() == [n > 0 for n in insults] and order("insults")[-1] == 4
    assert (got[:, at["near_second_person"]] > 0).tolist() == [False, True, True, False, False, False]
    assert (got[:, at["exclamations"]] > 0).tolist() == ["!" in t for t in rows] and (got[:, at["questions"]] > 0).tolist() == ["?" in t for t in rows]
    assert (got[:, at["upper_words"]] > 0).tolist() == [any(w.strip("?").isupper() and len(w) > 1 for w in t.split()) for t in rows]


def test_packing_ids_are_those_of_the_tokenizer_file():
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", "hello world\n", "é漢 😀  x", "don't  stop"]:
        assert packing.encoding().encode_ordinary(t) == file.encode(t, add_special_tokens=False).ids


def test_packing_ids_of_added_tokens(spark):
    """The literal at the start, in the middle, at the end, doubled, cut short and beside spaces."""
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    rng = random.Random(6)
    rows = [end, f"{end} a b", f"a {end} b", f"a b{end}", f"a  \n{end}\n  b", end * 2, f"<{end}>", end[:-1], f"x {end.upper()}", f"é{end}漢"]
    rows += ["".join(rng.choice([end, "<|", "|>", "endoftext", " ", "\n", "a", "é", "1", "."]) for _ in range(12)) for _ in range(300)]
    expected = [file.encode(t, add_special_tokens=False).ids for t in rows]
    assert [packing.ids_of(t, packing.encoding()) for t in rows] == expected and expected[2] == [64, 220, 50256, 275]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, packing.END], "<u4").tobytes())) for i, x in enumerate(expected)}


@pytest.mark.parametrize("seed", range(3))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    length, n = np.unique(np.clip(rng.lognormal(4, 1.2, 3000).astype(int), 1, 512), return_counts=True)
    runs = packing.plan(dict(zip(length.tolist(), n.tolist())), 512)
    held = {}
    for size, _, count, first, offset in runs:
        for s in range(first, first + count):
            held.setdefault(s, []).append((offset, size))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(b for _, b in spans) <= 512
    for size, count in zip(length, n):
        own = runs[runs[:, 0] == size]
        assert own[:, 2].sum() == count and own[0, 1] == 0 and (own[1:, 1] == own[:-1, 1] + own[:-1, 2]).all()
    assert len(held) <= 1.02 * -(-(length * n).sum() // 512)


def test_packing_ids_of_very_long_runs():
    """A million blanks and a million letters, which overflow the plain encoder's stack or take it for ever."""
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    for t in (" " * 30_000, "a" + " \n" * 20_000 + "b", f"x{end}" + "\t" * 15_000 + f"{end} y"):
        assert packing.ids_of(t, packing.encoding()) == file.encode(t, add_special_tokens=False).ids
    assert len(packing.ids_of(" " * 1_000_000 + "z" * 1_000_000, packing.encoding())) > 1000


def test_packed_rows_against_plain_packing(spark):
    """Every column by the tokenizer file and plain counting: ids, cuts, places without gaps or overlaps."""
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [None, ""] + [" ".join(rng.choice("one two three été 漢字 42".split()) for _ in range(rng.choice((3, 40, 300, 2500)))) for _ in range(60)]
    rows = packing.packed(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int")).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*file.encode(t or "", add_special_tokens=False).ids, packing.END]
        own, at = sorted(by_doc[i], key=lambda r: r.piece), 0
        assert len(own) == -(-len(ids) // 2048) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.start == at and 0 < r.length <= 2048 and (r.piece == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.1 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packed_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 5000), (3, "a " * 5000), (None, "b")], "doc_id long, text string")
    rows = packing.packed(df).collect()
    assert len(rows) == 3 + 2 * 3 and max(r.length for r in rows) == 2048
    assert packing.packed(df.limit(0)).count() == 0


def test_warc_files_are_read_as_files(spark, tmp_path):
    """Archives written as .warc.zst files and read with binaryFile, short and empty payloads and an empty table included."""
    html = ["<p>" + f"page {i} " * 30 + "</p>" for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://a.net/{i}", h) for i, h in enumerate([*html, html[3], "", None, "short"])], "page_id long, url string, html string")
    for r in warc.archives(pages.repartition(3)).collect():
        (tmp_path / r.archive).write_bytes(r.content)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path)).select(F.col("path").alias("archive"), "content")
    got = {r.page_id: r for r in warc.records(files).collect()}
    assert len(got) == 44 and all(got[i].payload == h.encode() for i, h in enumerate(html)) and got[40].record_type == "revisit" and got[40].refers_to == 3
    assert {got[i].record_type for i in (41, 42, 43)} == {"response"} and got[42].payload == b""
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_round_trip_and_refusals(spark):
    long = "x" * 150
    df = spark.createDataFrame([(2, "u\r\n", long), (1, "u", long), (3, None, None), (None, "v", long), (4, "w", "short"), (5, "w", "short")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()}
    assert got == {1: ("response", None, 150), 2: ("revisit", 1, 150), 3: ("response", None, 0), None: ("revisit", 1, 150), 4: ("response", None, 5), 5: ("response", None, 5)}
    w = warc.Writer(b"")
    good = warc.record(1, "u", b"abc", "d")
    w.add(good)
    assert [warc.parsed(x)[0]["warc-type"] for x in warc.frames(w.content())] == ["response"]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date: ", b"X: "), good + b"z"):
        with pytest.raises(warc.BadRecord):
            warc.parsed(bad)
    with pytest.raises(warc.BadRecord):
        list(warc.frames(w.content()[:-3]))


def test_warc_of_a_hot_payload_and_of_many_empty_ones(spark):
    """A third of the pages equal, a third without a payload, clashing columns: the rows of plain code, and no task with a third of them."""
    rows = [(i, "u", ("x" * 300, None, f"{i % 1500} " + "y" * 120, "")[i % 3 if i % 7 else 3], i, "d") for i in range(6000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size int, digest string").repartition(16)
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        parts = [r["n"] for r in warc.planned(df).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
        got = {r.page_id: (r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    finally:
        for name in plain:
            spark.conf.unset(name)
    first, want = {}, {}
    for i, _, html, *_ in rows:
        digest = hashlib.sha256((html or "").encode()).hexdigest()
        one = first.setdefault(digest, i) if len(html or "") >= 100 else i
        want[i] = (digest, "response" if one == i else "revisit", None if one == i else one)
    assert got == want and sum(parts) == 6000 and max(parts) < 600

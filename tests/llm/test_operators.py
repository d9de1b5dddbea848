"""Operators against brute force, and nulls, empty and very long texts, ties, repeated rows, empty tables and further columns."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrisk.llm import components, digest_index, edit_pairs, labelled, line_dedup, ngram_join, packing, piece_codec, quality, token_counts, topk_search, toxicity, url_filter
from sparkrisk.llm import pretokens as pt
from sparkrisk.llm.queries import URL_RULES, tokenizer_path

from ..conftest import SMALL
from . import helpers

BYTES, WORDS, PIECES = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD_TEXTS = [
    "", " ", "▁", "  a  b", "a\n b\n\nc ", "<s>a</s><0x41>", "x<|endoftext|>y <|STARTOFTEXT|>", "it's I'LL 'tis!'s", "abc" * 700, "a" * 3000, "中文 тест 😀 \u0301 İ", "\u0085\u00a0x", "tab\tand\r\nreturn", "word " * 5000,
    "½ ²³ ªº ŉ ſ ĳ", "##~~ --- ...", "ΑΣ ς",
]


def frame(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "x", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long")


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in range(32, 0x180)] + list("\n\t\r ") * 20 + [chr(c) for c in (0x2581, 0x4E2D, 0x1F600, 0x130, 0x85, 0xA0, 0xFFFD, 0x3A3, 0x301, 0)]
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(1500)]


def test_token_counts(spark, texts, random_texts):
    library = pt.load(BYTES)
    for t in [*texts[:60], *random_texts, *ODD_TEXTS]:
        assert token_counts.count(t, BYTES) == len(library.encode(t, add_special_tokens=False).ids), t[:80]
    got = token_counts.token_counts(frame(spark, [None, "", "a b"]), BYTES, limit=1).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, False), (1, 0, 0, False), (2, 3, 2, True)]
    assert token_counts.token_counts(frame(spark, []), BYTES).count() == 0


OTHER_TEXTS = [
    "“Smart” quotes – and dashes… cost €5", "Привет, мир! Как дела?", "中文没有空格的句子。第二句，还有3个数字１２", "日本語のテキスト　全角", "नमस्ते दुनिया ١٢٣", "a\u00a0b \u3000 c  \u2003d", "x\u0085 y \x1c z", "naïve café – ŉ ǆ ",
    "emoji 😀😀 and 👍🏽 flags 🇫🇷", "Σίσυφος ΟΔΟΣ", "e\u0301 \u0301 a", "\u200bzero \ufeffwidth", "ﬁ ① Ⅷ ½ ²", "한국어 텍스트", "שלום עולם", "\ud7ff \ufffd \U0001F9E0 \U00020000", "don’t DON'T’s 'S", "中" * 3000 + " end", "ñ" * 300 + " – " + "q" * 5000,
]


def test_texts_of_other_scripts_like_the_library(random_texts):
    """Stretches with other characters are counted, and their words encoded, as the library does, by the method where kinds are steady."""
    byte, word = pt.load(BYTES), pt.load(WORDS)
    rng = random.Random(11)
    mixed = [" ".join(rng.choices([*" ".join(OTHER_TEXTS).split(" "), "", "plain", "\n", "words\t"], k=12)) for _ in range(300)]
    for t in [*OTHER_TEXTS, *mixed, *random_texts]:
        assert token_counts.count(t, BYTES) == len(byte.encode(t, add_special_tokens=False).ids), t[:80]
        assert np.frombuffer(packing.encode(t, WORDS), dtype="<u2").tolist() == word.encode(t, add_special_tokens=False).ids, t[:80]
    by_method = [bool(pt.steady().fullmatch(s)) for t in OTHER_TEXTS[:4] for s in pt.CUT.split(t)]
    assert np.mean(by_method) > 0.9


def test_steady_characters_split_like_the_library():
    """Every steady character between letters, digits and signs."""
    library = pt.load(BYTES).pre_tokenizer
    known = [chr(c) for c in range(0x20, 0x30000) if pt.steady().fullmatch(chr(c))]
    assert len(known) > 80_000
    back = {v: k for k, v in pt.byte_letters().items()}
    for at in range(0, len(known), 500):
        t = "".join(f"a{c}b 1{c}2 !{c}? {c}{c}" for c in known[at : at + 500])
        want = [bytes(back[x] for x in piece).decode("utf-8", "replace") for piece, _ in library.pre_tokenize_str(t)]
        assert pt.GENERAL_PATTERN.findall(t) == want


def test_known_characters_split_like_the_library():
    """Every known character, alone and beside others, in both vocabularies."""
    known = [chr(c) for c in range(0x180) if pt.KNOWN.fullmatch(chr(c))]
    byte, word = pt.load(BYTES), pt.load(WORDS)
    for c in known:
        for t in (c, f"a{c}b", f" {c}{c}1", f"1 {c}'s", f"!{c}?"):
            assert token_counts.count(t, BYTES) == len(byte.encode(t, add_special_tokens=False).ids)
            assert np.frombuffer(packing.encode(t, WORDS), dtype="<u2").tolist() == word.encode(t, add_special_tokens=False).ids


def test_whole_tokens_are_proven():
    whole, library = token_counts.whole_tokens(BYTES), pt.load(BYTES)
    assert len(whole) > 40_000
    assert all(len(library.model.tokenize(pt.byte_level(w))) == 1 for w in random.Random(1).sample(sorted(whole), 300))


def test_piece_codec(spark, texts, random_texts):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.codec(PIECES)
    every = [*texts[:60], *random_texts, *ODD_TEXTS, "ab" * 2000, "中" * 900]
    for t, ids in zip(every, own.encode_batch(every), strict=True):
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, t[:80]
        assert own.decode(ids) == sp.decode(want)
    rows = piece_codec.round_trips(frame(spark, [None, ""]), PIECES).collect()
    assert [r["n_tokens"] for r in rows] == [2, 2]


@pytest.mark.parametrize("longest", [4096, 30])
def test_piece_codec_rounds_equal_single_merges(monkeypatch, longest):
    """Merges of a rank at once, and the heap, against the leftmost best pair, one after another; short and very long words."""
    monkeypatch.setattr(piece_codec, "LONG_SEGMENT", longest)
    own = piece_codec.codec(PIECES)
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choices("abcdeéstionß中aaa", k=rng.randrange(1, 40))) for _ in range(300)] + ["▁" + "a" * 700, "▁" + "abab" * 200, "▁" + "ationa" * 150]
    for w, got in zip(words, own.rounds(words), strict=True):
        symbols = own.symbol[np.frombuffer(w.encode("utf-32-le"), dtype="<u4")]
        while len(symbols) > 1:
            rank, at = own.pairs(symbols[:-1], symbols[1:])
            k = int(rank.argmin())
            if rank[k] == piece_codec.NONE:
                break
            symbols = np.r_[symbols[:k], own.merged[at[k]], symbols[k + 2 :]]
        assert (got == symbols).all(), w[:50]


def test_piece_codec_of_nothing_and_repeats(spark):
    assert piece_codec.round_trips(frame(spark, []), PIECES).count() == 0
    docs = frame(spark, ["same", "same"], ids=[4, 4]).withColumn("n_tokens", F.lit("mine"))
    assert [r["n_tokens"] for r in piece_codec.round_trips(docs, PIECES).collect()] == [3, 3]


def test_packing(spark, texts):
    docs = [None, "", *texts, "word " * 9000, *texts[:5]]
    rows = [r.asDict() for r in packing.pack_documents(frame(spark, docs, ids=[*range(len(docs) - 5), *range(2, 7)]).repartition(3), WORDS).collect()]
    library = pt.load(WORDS)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(docs[:-5])}
    by_sequence: dict = {}
    covered: dict = {}
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {k: len(v) * (2 if 2 <= k < 7 else 1) for k, v in ids.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0  # no padding at all
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    for _ in range(30):
        lengths, window = [rng.randrange(1, 60) for _ in range(80)], 32
        rest, open_to = sorted((n % window for n in lengths if n % window), reverse=True), []
        for n in rest:
            fits = [k for k in open_to if k >= n]
            open_to.remove(min(fits)) if fits else None
            open_to.append((min(fits) if fits else window) - n)
        assert len(packing.best_fit_decreasing(lengths, window)) == sum(n // window for n in lengths) + len(open_to)


def test_url_filter_of_long_hosts_and_bad_rules(spark, tmp_path):
    import time

    long = "a." * 200_000 + "net"
    began = time.time()
    rows = url_filter.filter_urls(spark.createDataFrame([(1, f"x://{long}/{'p' * 100_000}"), (1, f"x://{long}"), (2, "x://" + "b" * 300_000)], "page_id long, url string"), URL_RULES).collect()
    assert [r["rule"] for r in rows] == ["net/", None, None] and time.time() - began < 60
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, host string"), URL_RULES).count() == 0
    for bad in ([("a", "/", "block"), ("a", "/", "allow")], [("a", "/", "drop")]):
        with pytest.raises(ValueError):
            url_filter.build(bad)


def test_url_filter(spark, tmp_path):
    urls = ["http://a.b.net/x", "HTTPS://A.Example.NET/en/q?x", "http://example.net/EN/", "ftp://net", "http://xnet/a", "http://example.com/de/a#b", "http://x.org/fr/", "http://é.org/fr/Ü", None, "", "no scheme", "http://a?b://c.net/", "x://u@Y.Net:80/p\nq?r"]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("")), URL_RULES).collect()}
    assert got[0] == ("a.b.net", "/x", "net/", "block") and got[1] == ("a.example.net", "/en/q", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("net", "", None, "allow") and got[4][2] is None and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == got[7][2:] == ("org/fr/", "allow")
    assert all(got[k] == ("", "", None, "allow") for k in (8, 9, 10)) and got[11][:2] == ("a", "") and got[12][0] == "u@y.net:80"
    # all keys collide: only the stored strings can tell rules apart
    (tmp_path / "index").write_bytes(url_filter.build(URL_RULES, hash_of=lambda s: 7))
    own = url_filter.DigestArray(str(tmp_path / "index"), hash_of=lambda s: 7)
    assert [own.rule(i) if i >= 0 else None for i in own.judge(["a.example.net", "example.com", "q"], ["/en/", "/de/x", "/"])] == ["example.net/en/", "example.com/de/", None]


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    """With digests of one byte, hundreds of different texts collide and bytes must decide."""
    rng = random.Random(6)
    docs = [rng.choice(["a  b", "a b", "a\t\nb", "", None, " ", f"t{rng.randrange(90)}", f"t{rng.randrange(90)} ", "ü" * 5000]) for _ in range(500)]
    got = {r["doc_id"]: tuple(r)[1:] for r in digest_index.exact_duplicates(frame(spark, docs).repartition(5), digest_bytes=digest_bytes, hit_bits=1 << 16).collect()}
    assert got == helpers.copies(enumerate(docs))
    assert digest_index.exact_duplicates(frame(spark, []), hit_bits=1 << 16).count() == 0


def test_digest_index():
    rng, index, want = random.Random(8), digest_index.DigestIndex(memtable=20, runs=3), {}
    for _ in range(2000):
        d, i = bytes([rng.randrange(200)]) * 15 + bytes([rng.randrange(2)]), rng.randrange(10**6)
        index.insert(d, i)
        want[d] = (min(i, want.get(d, (i, 0))[0]), want.get(d, (i, 0))[1] + 1)
    assert all(index.get(d) == v for d, v in want.items()) and index.get(b"\xff" * 16) is None
    out = index.merged()
    assert {d.ljust(16, b"\0"): (i, n) for d, i, n in zip(out.digests.tolist(), out.ids.tolist(), out.counts.tolist(), strict=True)} == want


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_topk(spark, monkeypatch, broadcast):
    """By broadcast and by the grid; ties, repeated ids, vectors of other lengths, and values that only whole numbers of any size hold."""
    monkeypatch.setattr(topk_search, "CANDIDATES", 37)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    monkeypatch.setattr(topk_search, "BROADCAST", broadcast)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 8)) * rng.choice([0.1, 1, 30], size=(150, 1))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)] + [(150, None), (151, [1.0, None] * 4), (152, [float("nan")] * 8), (153, [float("inf")] * 8), (154, [0.0] * 8), (160, [0.0] * 8), (161, [1.0] * 8), (161, [1.0] * 8), (163, [1.0, 2.0]), (180, [3.0, -1.0]), (180, [-3.0, 1.5]), (164, [1e308] * 8), (165, [3e7, -1.0] * 4), (None, [9.0] * 8)]
    got = {}
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("score", "rank", "q", "block", "row")})
    for r in topk_search.top_k(docs, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(64 * x) for x in v)]
    for q in {i for i, _ in good if i % 20 == 0}:
        mine = [v for i, v in good if i == q]
        best = sorted((-max(sum(a * b for a, b in zip(x, v, strict=True)) for x in mine if len(x) == len(v)), i) for i, v in good if i != q and len(v) == len(mine[0]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_topk_of_huge_components():
    """Beyond 64 bits the ranking is exact."""
    vectors = np.array([[2.0**60, 1.0], [2.0**60, 2.0], [-(2.0**60), 0.0]])
    _, _, ids, scores = next(topk_search.search(vectors, np.array([[2.0**40, 1.0]]), np.array([9]), np.array([1, 2, 3]), 2))
    assert ids.tolist() == [2, 1] and scores.tolist() == [2**100 + 2, 2**100 + 1]


def test_topk_stops_on_proof(spark):
    """On the given vectors most batches stop before the last step, and postings of a level hold its components."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", topk_search.quantised(F.col("embedding"), 64).alias("q")).collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["q"] for r in rows], dtype=np.float64)
    index = topk_search.ImpactIndex(vectors)
    assert (sum(index.segment(b, np.float64) for b in range(index.top + 1)).T == vectors).all()
    queries = ids % 20 == 0
    possible, steps, of = topk_search.possible_members(index, vectors, vectors[queries], ids[queries][:, None] == ids[None, :], 20, np.float32)
    assert steps < of and possible.sum() < 8 * 20 * queries.sum() + 1


@pytest.mark.parametrize("at_once", [1_000_000, 20])
def test_components(spark, monkeypatch, at_once):
    """In one task, and in several with joins between them."""
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def mutated(rng, words, vocabulary):
    words = list(words)
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        k = rng.randrange(len(words) + 1)
        words[k : k + rng.randrange(2)] = [rng.choice(vocabulary)]
    return " ".join(words) if rng.random() < 0.8 else "  \n".join(words).upper()


@pytest.mark.parametrize("documents,shingles", [(4000, 1_000_000), (7, 500)])
def test_ngram_join(spark, monkeypatch, documents, shingles):
    """With one cell per block, and with blocks cut into many cells."""
    monkeypatch.setattr(ngram_join, "CELL_DOCUMENTS", documents)
    monkeypatch.setattr(ngram_join, "CELL_SHINGLES", shingles)
    rng = random.Random(10)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 20, 60]))] for _ in range(12)]
    docs = [mutated(rng, rng.choice(base), vocabulary) for _ in range(400)] + [None, "", " \n "]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_classes(frame(spark, docs).repartition(5), bits=1 << 16).collect()}
    assert got == helpers.classes(list(enumerate(docs)))


def test_ngram_join_keeps_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [text, text + " x", "other words that are here", None, ""], ids=[7, 3, 5, None, 9])
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 3, 5, 9]
    assert ngram_join.similarity_classes(frame(spark, [])).count() == 0


def test_ngram_join_of_repeated_ids(spark):
    """An id with two texts is one document: what either is linked with is linked with both. Of its rows one stays."""
    a, b = ([f"{c}{k}" for k in range(40)] for c in "ab")
    docs = frame(spark, [" ".join(a), " ".join(b[:12]), " ".join([*a, "x"]), " ".join([*b[:12], "y"]), " ".join(a)], ids=[1, 1, 2, 3, 1]).withColumn("_gone", F.lit(1))
    got = sorted(tuple(r) for r in ngram_join.similarity_classes(docs).collect())
    assert got == [(1, 8, 1), (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 9, 1)]
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [1]


def test_exact_dedup_of_repeated_rows(spark):
    docs = frame(spark, ["a", "a", "a", "b", "a"], ids=[1, 1, 2, 1, None]).repartition(3)
    got = sorted(tuple(r)[:4] for r in digest_index.exact_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False)]


def test_exact_dedup_with_small_memories(spark, monkeypatch):
    """Many flushes and runs, no filter, and forgetful comparisons give the same groups."""
    for name, value in (("MEMTABLE", 3), ("MOST_ENTRIES", 10), ("MOST_LETTERS", 20)):
        monkeypatch.setattr(digest_index, name, value)
    docs = [f"t{k % 37}" for k in range(300)]
    got = {r["doc_id"]: tuple(r)[1:] for r in digest_index.exact_duplicates(frame(spark, docs).repartition(3), digest_bytes=1, hit_bits=1 << 4).collect()}
    assert got == helpers.copies(enumerate(docs))


def test_cell_links_stay_linear():
    base = np.sort(np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64))
    sets = [np.sort(np.r_[base[:-1], np.uint64(k)]) for k in range(400)]
    assert len(ngram_join.cell_links(list(range(400)), [0] * 400, sets, False)) == 399


def test_bounded_edit_distance():
    rng = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(8))) for _ in range(2))
        assert all(line_dedup.within(a, b, k) == (helpers.distance(a, b) <= k) for k in range(4))


@pytest.mark.parametrize("most", [64, 2])
def test_line_dedup(spark, monkeypatch, most):
    """With most = 2 nearly all keys are too common for pairs and go through the finer rounds."""
    monkeypatch.setattr(line_dedup, "MOST_IN_RUN", most)
    rng = random.Random(12)
    base = ["".join(rng.choices("abcd ", k=rng.randrange(10, 40))) for _ in range(6)]

    def changed(line):
        letters = list(line)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k, kind = rng.randrange(len(letters)), rng.randrange(3)
            letters[k : k + (kind != 1)] = [] if kind == 2 and len(letters) > 5 else [rng.choice("abcdexyz")]
        return "".join(letters)

    docs = ["\n".join(changed(rng.choice(base)) for _ in range(rng.randrange(0, 6))) for _ in range(120)] + [None]
    out = line_dedup.without_repeated_lines(frame(spark, docs).repartition(4), bits=1 << 16)
    got = {r["doc_id"]: r["text"] or "" for r in out.collect()}
    assert got == helpers.lines_left(list(enumerate(docs)), line_dedup.LEAST_CHARS)
    assert out.columns == ["doc_id", "text", "source", "n", "n_lines", "n_dropped"]


def test_distance():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(20))) for _ in range(2))
        assert line_dedup.distance(a, b) == helpers.distance(a, b)
        assert all(line_dedup.within(a, b, k) == (helpers.distance(a, b) <= k) for k in (4, 6))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "ab\u00e9\u6f22", "ab\U0001f600x"])
def test_distances_of_many_pairs(monkeypatch, letters):
    """All pairs at once, none one by one, in characters of one, two and four bytes."""
    monkeypatch.setattr(edit_pairs, "POINTS_AT_ONCE", 500)
    rng = random.Random(7)
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(40)] + ["", letters[0] * 40]
    texts += ["".join(rng.choices(x, k=1) * 2 + [x[3:]]) if len(x) > 3 else x for x in texts]
    a, b = (np.array([rng.randrange(len(texts)) for _ in range(1500)]) for _ in range(2))
    b[::2] = (a[::2] + 42) % len(texts)
    most = np.array([rng.randrange(9) for _ in a])
    want = [helpers.distance(texts[i], texts[j]) <= k for i, j, k in zip(a, b, most, strict=True)]
    assert edit_pairs.Texts(texts).within(a, b, most).tolist() == want
    assert 200 < sum(want) < 1300
    monkeypatch.setattr(line_dedup, "FEW_PAIRS", 0)
    monkeypatch.setattr(line_dedup, "within", lambda *x: pytest.fail("pairs are compared one by one"))
    late = line_dedup.late_of(a, b, np.arange(len(a)), most, texts)
    assert late.tolist() == sorted({int(i) for i, near in zip(a, want, strict=True) if near})


def test_distances_of_long_and_few_pairs(monkeypatch):
    """Long lines, and few pairs, are compared one by one, with the same result."""
    monkeypatch.setattr(line_dedup, "LONGEST_AT_ONCE", 20)
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab", k=rng.randrange(30))) for _ in range(30)]
    for n in (0, 3, 200):
        a, b = (np.array([rng.randrange(len(texts)) for _ in range(n)], dtype=np.int64) for _ in range(2))
        want = {int(i) for i, j in zip(a, b, strict=True) if helpers.distance(texts[i], texts[j]) <= 8}
        assert line_dedup.late_of(a, b, np.zeros(n), np.full(n, 8), texts).tolist() == sorted(want)


@pytest.mark.parametrize("per,most,longest", [(10, 64, 90), (30, 64, 270), (30, 2, 270), (30, 64, 900)])
def test_line_dedup_threshold_grows(spark, monkeypatch, per, most, longest):
    """Lines of all lengths with edits around their threshold, against all pairs. With most = 2 nearly all segments count as common."""
    monkeypatch.setattr(line_dedup, "MOST_IN_RUN", most)
    monkeypatch.setattr(line_dedup, "CELL_LINES", 4000 if most == 64 else 5)
    rng = random.Random(per + longest)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randrange(15, longest))) for _ in range(10)] + ["ab" * 100, "x" * 200]

    def changed(line):
        letters = list(line)
        for _ in range(rng.randrange(0, max(1, len(line) // per) + 2)):
            k, kind = rng.randrange(len(letters)), rng.randrange(3)
            letters[k : k + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdexyz")]
        return "".join(letters)

    docs = ["\n".join(changed(rng.choice(base)) for _ in range(rng.randrange(0, 4))) for _ in range(60)] + [None]
    out = line_dedup.without_repeated_lines(frame(spark, docs).repartition(4), bits=1 << 16, per=per)
    got = {r["doc_id"]: r["text"] or "" for r in out.collect()}
    assert got == helpers.lines_left(list(enumerate(docs)), line_dedup.LEAST_CHARS, lambda n: max(1, n // per))
    assert got != helpers.lines_left(list(enumerate(docs)), line_dedup.LEAST_CHARS)


def test_segments_survive_edits():
    """Of two lines within their threshold one has a segment that is one of the other's, at about the same place."""
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choices("abc ", k=rng.randrange(60, 400)))
        letters = list(a)
        for _ in range(len(a) // 30):
            k, kind = rng.randrange(len(letters)), rng.randrange(3)
            letters[k : k + (kind != 1)] = [] if kind == 2 else [rng.choice("abcd")]
        b = "".join(letters)
        if min(len(a), len(b)) >= 60 and helpers.distance(a, b) <= min(len(a), len(b)) // 30:
            of = [dict(zip(*(x.tolist() for x in line_dedup.segments([x], 30, line_dedup.gram_size(30))[::2]), strict=True)) for x in (a, b)]
            assert set(of[0]) & set(of[1])


def test_segments_are_sent_in_ten_bytes():
    """What is packed per bucket comes back, with 24 bits of the keys, in ten bytes for a segment."""
    rng = np.random.default_rng(5)
    key, ref = rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 1 << 32, 5_000, dtype=np.uint32)
    size, cell = rng.integers(60, 1 << 16, 5_000), rng.integers(0, 256, 5_000).astype(np.uint8)
    buckets, strings = (c.to_pylist() for c in line_dedup.dealt(key, ref, size, cell, 64).columns)
    assert sum(map(len, strings)) == 10 * len(key)
    of = np.repeat(buckets, [len(x) // 10 for x in strings])
    got = sorted(zip(of.tolist(), *(x.tolist() for x in line_dedup.unpacked(strings)), strict=True))
    assert got == sorted(zip(((key >> np.uint64(32)) % np.uint64(64)).tolist(), (key & np.uint64((1 << 24) - 1)).tolist(), ref.tolist(), size.tolist(), cell.tolist(), strict=True))


def test_segments_meet_before_other_tables_are_there(spark, monkeypatch):
    """The step that takes the most disk finds no table of the other steps."""
    from sparkrisk.llm import common

    before, met, make = len(common.CUTS.paths), [], line_dedup.met_lines
    monkeypatch.setattr(line_dedup, "met_lines", lambda *a: met.append(len(common.CUTS.paths) - before) or make(*a))
    docs = [" ".join(f"w{k // 2}x{j}" for j in range(40)) + f" {k % 2}" for k in range(8)]
    left = line_dedup.without_repeated_lines(frame(spark, docs), per=30)
    assert met == [0] and left.where("n_dropped > 0").count() == 4
    assert len(common.CUTS.paths) - before <= 1


def test_line_dedup_of_short_and_blank_lines(spark):
    docs = ["Read more\nShare\nRead more\n\n  \n", "Read more\nShare\n\nown", "\n\n", "  \n "]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.without_repeated_lines(frame(spark, docs), bits=1 << 16).collect()}
    assert got == {0: ("Read more\nShare\n\n  \n", 6, 1), 1: ("\nown", 4, 2), 2: ("\n\n", 3, 0), 3: ("  \n ", 2, 0)}


def test_line_dedup_with_clashing_names(spark):
    docs = frame(spark, ["same line here", "same line here\nmore"]).withColumns({c: F.lit("mine") for c in ("n_lines", "N_Dropped", "_lines", "_of", "_digest", "lines", "line", "near", "size")})
    out = line_dedup.without_repeated_lines(docs, bits=1 << 16)
    assert sorted((r["doc_id"], r["text"], r["n_dropped"], r["_of"], r["near"]) for r in out.collect()) == [(0, "same line here", 0, "mine", "mine"), (1, "more", 1, "mine", "mine")]


def test_line_dedup_without_filters(spark, monkeypatch):
    """Beyond the filters' bound all rows are passed on, with the same result."""
    docs = [f"a line that is long enough {k % 40}\nand one that is its own {k * 7919}" for k in range(200)]
    some = lambda: sorted((r["doc_id"], r["text"]) for r in line_dedup.without_repeated_lines(frame(spark, docs), bits=bits, per=30).collect())
    bits = 1 << 16
    want = some()
    monkeypatch.setattr(line_dedup, "hit_filter", lambda digests, most: None)
    assert some() == want


def test_line_dedup_forgets(spark, monkeypatch):
    """A small memory of lines met, and lines beyond the letters handled at once."""
    monkeypatch.setattr(line_dedup, "MOST_SEEN", 3)
    monkeypatch.setattr(line_dedup, "LETTERS_AT_ONCE", 64)
    monkeypatch.setattr(line_dedup, "SEGMENTS_AT_ONCE", 10)
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh ", k=150)) for _ in range(5)]
    docs = ["\n".join(rng.choice(base) + rng.choice(["", "x", "yz"]) for _ in range(3)) for _ in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(frame(spark, docs), bits=1 << 16, per=30).collect()}
    assert got == helpers.lines_left(list(enumerate(docs)), line_dedup.LEAST_CHARS, lambda n: max(1, n // 30))


def test_line_dedup_of_nothing(spark):
    assert line_dedup.without_repeated_lines(frame(spark, []), bits=1 << 16).count() == 0
    assert line_dedup.without_repeated_lines(frame(spark, ["x" * 30, None], ids=[None, 1]), bits=1 << 16).count() == 2


@pytest.fixture(scope="module")
def labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = docs.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"))).select("text", "quality", "toxic").collect()
    return docs, labels, held


def test_folds(spark):
    got = spark.range(200).select("id", labelled.fold(F.col("id"))).collect()
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 4 for r in got)


def test_quality(spark, labelled_rows):
    docs, labels, held = labelled_rows
    model = quality.model_for(docs, labels)
    right = np.mean((model.scores([r["text"] for r in held]) >= 0.7) == [r["quality"] == 1 for r in held])
    assert right >= 0.9
    again = quality.model_for(docs.withColumn("more", F.lit(1)), labels)
    assert (again.scores(["a b c"]) == model.scores(["a b c"])).all()
    rows = quality.score_documents(frame(spark, [None, "", "and the " * 20_000]), model).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit([]).scores(["x"])[0] == 0.5 and quality.fit([("x", 1)]).scores(["x"])[0] == 1.0


def test_toxicity(spark, labelled_rows):
    docs, labels, held = labelled_rows
    model = toxicity.model_for(docs, labels)
    toxic = np.array([r["toxic"] == 1 for r in held])
    found = model.exceeding([r["text"] for r in held])[:, 0] >= 0.5
    assert (found == toxic).mean() >= 0.9 and found[~toxic].mean() <= 0.05
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = toxicity.score_documents(frame(spark, [None, "", "idiot clown moron scum"]), model).orderBy("doc_id").collect()
    assert rows[0]["severity"] == rows[1]["severity"] < rows[2]["severity"] and not rows[0]["toxic"]
    assert not toxicity.score_documents(frame(spark, ["x"]), toxicity.fit([])).first()["toxic"]


def test_ordinal_likelihood():
    """Loss against the plain formula, and gradients against differences."""
    rng = np.random.default_rng(4)
    z, t, grades = rng.normal(size=40) * 2, np.array([-0.5, 0.3, 1.2]), rng.integers(0, 4, 40)
    loss = lambda z, t: toxicity.loss_and_gradients(z, t, grades)[0]
    above = lambda x, k: 1.0 if k < 0 else 0.0 if k > 2 else 1 / (1 + np.exp(-(x - t[k])))
    assert abs(loss(z, t) + np.mean([np.log(above(x, g - 1) - above(x, g)) for x, g in zip(z, grades, strict=True)])) < 1e-12
    _, by_z, by_t = toxicity.loss_and_gradients(z, t, grades)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert abs((loss(z, t + step) - loss(z, t - step)) / 2e-6 - by_t[k]) < 1e-6
    for k in range(40):
        step = np.eye(40)[k] * 1e-6
        assert abs((loss(z + step, t) - loss(z - step, t)) / 2e-6 * 40 - by_z[k]) < 1e-5


def test_toxicity_scores_by_hand():
    model = toxicity.ToxicityModel({"bad": 2.0, "badl*": 1.0, "nice": -1.0}, np.array([1.0, 2.0, 4.0]))
    for text, z in (("Bad, badly bad", 3.0), ("nice bad", 1.0), ("", 0.0), ("else", 0.0)):
        assert np.allclose(model.exceeding([text])[0], [1 / (1 + np.exp(-(z - t))) for t in (1.0, 2.0, 4.0)])


def test_random_indexing_and_network_by_hand():
    """Context vectors against loops over all neighbours, pooled inputs and the forward pass against plain sums."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "Delta", "x9", "!!"], k=30)) for _ in range(40)]
    model = quality.learn_vectors(texts)
    rows, index = model.rows(), {}
    for s, r in model.shapes.items():
        index[r] = quality.index_vector(f"shape {s}")
    for w, r in model.forms.items():
        index[r] = quality.index_vector(f"form {w}") + index.get(model.shapes.get(quality.shape(w)), 0)
    context = np.zeros((len(model.vectors), quality.DIMENSIONS))
    for text in texts:
        words = [rows[w] for w in text.split()]
        for i, w in enumerate(words):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    context[w] += index.get(words[j], 0)
    for w, r in model.forms.items():
        shape_row = model.shapes.get(quality.shape(w))
        if shape_row:
            context[shape_row] += context[r]
    context[0] = 0
    context -= context.sum(axis=0) / max(1.0, np.abs(context).sum()) * np.abs(context).sum(axis=1, keepdims=True)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    own = np.array([unit(context[r]) + 0.5 * unit(np.asarray(index.get(r, np.zeros(quality.DIMENSIONS)), dtype=np.float64)) for r in range(len(context))])
    want = own.copy()
    for w, r in model.forms.items():
        want[r] += own[model.shapes[quality.shape(w)]]
    want[0] = 0
    assert np.allclose(model.vectors, want, atol=1e-4)
    text = "alpha beta beta unknownword\n!! x9"
    pooled = model.inputs([text])[0]
    assert np.allclose(pooled[: quality.DIMENSIONS], np.mean([model.vectors[rows[w]] for w in text.split()], axis=0), atol=1e-5)
    assert np.allclose(pooled[quality.DIMENSIONS :], [np.log1p(6), 5 / 6, np.log1p(5), 1.0])
    d, h = len(pooled), 3
    gen = np.random.default_rng(1)
    model.network, model.mean, model.spread, model.temperature = [gen.normal(size=(d, h)), gen.normal(size=h), gen.normal(size=h), np.float64(0.2)], np.zeros(d), np.ones(d), 2.0
    w1, b1, w2, b2 = model.network
    hidden = [np.tanh(sum(pooled[i] * w1[i, j] for i in range(d)) + b1[j]) for j in range(h)]
    assert np.isclose(model.scores([text])[0], 1 / (1 + np.exp(-(sum(a * b for a, b in zip(hidden, w2, strict=True)) + b2) / 2.0)))


def test_network_learns_what_no_line_parts():
    gen = np.random.default_rng(5)
    x = gen.normal(size=(6000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    w1, b1, w2, b2 = quality.train(x, y, np.random.default_rng(0))
    p = quality.sigmoid(np.tanh(x @ w1 + b1) @ w2 + b2)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9


def test_classifiers_of_nothing_and_repeats(spark):
    docs, labels = frame(spark, ["a b", "a b", None], ids=[1, 1, 2]).withColumn("score", F.lit("mine")), spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.score_documents(docs, module.model_for(docs, labels)).count() == 3
        empty = frame(spark, [])
        assert module.score_documents(empty, module.model_for(empty, labels.limit(0))).count() == 0


def test_tables_on_the_way_go(spark):
    """Of the tables that an operator cuts its plan with, those stay whose rows its result reads, and no others."""
    from sparkrisk.llm import common

    docs = [f"the same words stand in this line {k % 7}\n" + " ".join(f"w{k % 20}x{j}" for j in range(40)) for k in range(60)]
    before = len(common.CUTS.paths)
    classes = ngram_join.similarity_classes(frame(spark, docs))
    left = line_dedup.without_repeated_lines(frame(spark, docs), per=30)
    held = common.CUTS.paths[before:]
    assert len(held) <= 4  # the described documents, ids of several, classes, and the lines to drop
    assert all(os.path.isdir(p.removeprefix("file:")) for p in held)
    assert classes.count() == left.count() == 60


def test_a_worker_forgets_other_operators_words():
    from sparkrisk.llm import common

    ran = lambda owner: [*common.tidied(lambda batches: iter([ngram_join.word_hashes()[x] for x in batches]), owner)([b"a", b"b"])]
    ran("one")
    assert len(ngram_join.word_hashes()) == 2  # they stay between tasks of one operator
    common.begin_task("one")
    assert len(ngram_join.word_hashes()) == 2
    common.begin_task("another")
    assert len(ngram_join.word_hashes()) == 0

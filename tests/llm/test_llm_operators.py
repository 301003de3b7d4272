"""The operators of the training-data pipeline against brute force, and on nulls, ties, empty and odd inputs."""

import binascii
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from brindle.llm import ann, encoding, mixing, packing, pitman_yor, simhash, token_count, topk, toxicity, warc, wavelet

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Names that operators use inside, as further columns of the input.
CLASH = {"fp": 1, "component_id": 2, "row": 3, "score": 4.0, "ids": "x", "key": 5, "group": "g", "block": 1, "tokens": 9}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "word " * 30_000
TEXTS = [(1, "One two three four five"), (2, None), (3, ""), (4, "One two three four five"), (4, "One two three four five"), (None, "lost id"), (5, "  spaces\t\nand é ñ ß 日本 <|endoftext|> ▁x  "), (6, "a" * 3000), (7, LONG), (8, " "), (9, "it's I'll we'd 123 4.5!")]


def frame(spark, pairs, clash=True):
    df = spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k}", None) for k, (i, t) in enumerate(pairs)], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


@pytest.fixture
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture
def none(spark):
    return frame(spark, [])


# 1 WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int")


def test_warc_digests(spark):
    same, inner = "x" * 200, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 5
    rows = [(3, "u", same), (1, "u", same), (1, "v", same), (2, None, same), (None, "u", same), (4, "a b\r\nx", "short"), (5, "u", "short"), (6, "u", None), (7, "u", inner), (8, "u", "é" * 60_000), (9, "u", inner)]
    df = pages(spark, [(*r, "d", 1) for r in rows])
    manifest = warc.write(df, archive_bytes=1000)
    got = Counter(map(tuple, warc.digests(warc.read(manifest, range_bytes=97)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        again = len(data) >= 100 and page != first
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want


@pytest.mark.parametrize("range_bytes", [50_000, 1 << 20])
def test_warc_long_headers(spark, range_bytes):
    rows = [(k, "é" * 15_000 if k == 2 else f"u{k}", f"page {k}", "d", 1) for k in range(6)]  # 90,000 bytes as written
    got = warc.read(warc.write(pages(spark, rows).coalesce(1)), range_bytes=range_bytes).collect()
    assert sorted((r.page_id, len(r.url), bytes(r.payload)) for r in got) == [(k, 90_000 if k == 2 else 2, f"page {k}".encode()) for k in range(6)]


def test_warc_lost_records_fail(spark):
    manifest = warc.write(pages(spark, [(1, "u", "one", "d", 1), (2, "u", "two", "d", 1)]))
    for change in ({"n_records": F.col("n_records") + 1}, {"n_bytes": F.col("n_bytes") + 1}):
        with pytest.raises(ValueError, match="the chain ends"):
            warc.read(manifest.withColumns(change))


def test_warc_empty(spark):
    assert warc.digests(warc.read(warc.write(pages(spark, [])))).count() == 0


# 2 Packing


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = packing.pack(docs, WORD, capacity=64, open_bins=4).collect()
    check_packed(rows, 64)
    got, want = Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows), Counter()
    for doc, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[doc, k // 64, k, len(part), part.tobytes()] += 1
    assert got == want


def test_packing_empty(none):
    assert packing.pack(none, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 6))
def test_best_fit(lengths, most):
    """Against a plain list of open bins."""
    fit, bins, made = packing.BestFit(30, most), [], 0
    for n in lengths:
        which, offset = fit.place(n)
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            free = min(b[1] for b in fitting)
            assert any(b[0] == which and b[1] == free for b in fitting) and offset == 30 - free
            bins = [b for b in bins if b[0] != which]
        else:
            free = 30
            assert which == made and offset == 0
            made += 1
        if free > n:
            bins.append((which, free - n))
        if len(bins) > most:
            low = min(b[1] for b in bins)
            bins.remove([b for b in bins if b[1] == low][-1])
        assert len(bins) == fit.open


# 3 Language model


def test_language_model_counts(spark, docs):
    got = pitman_yor.score(docs, ranges=3).collect()
    words = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    c = Counter(w for d, t in TEXTS if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for d, t in TEXTS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_language_model_learns(spark):
    draw = random.Random(3)
    a, b = [f"{k}aa" for k in "cdefgh"], [f"{k}bb" for k in "cdefgh"]
    texts = [(k, " ".join(draw.choices(a if k % 2 else b, k=80))) for k in range(120)]
    got = pitman_yor.score(frame(spark, texts, False)).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_whole_word_contexts(spark):
    """All words that choose the next one end alike, so that only the whole word tells which it is."""
    draw = random.Random(5)
    texts = [(k, " ".join(w for i in draw.choices(range(16), k=60) for w in (f"{chr(97 + i)}zzz", f"{chr(97 + i)}yyy"))) for k in range(120)]
    held = [r for r in pitman_yor.score(frame(spark, texts, False), ranges=3).collect() if r.held_out]
    assert held and max(r.perplexity for r in held) < 8  # 4 is the source's own; 16 where contexts that end alike are one


def test_language_model_empty(none):
    assert pitman_yor.score(none).count() == 0


def test_seating():
    draw = np.random.default_rng(1)
    sizes = np.zeros((500, 6), np.float32)
    sizes[:, 0] = 6
    for _ in range(3):
        sizes = pitman_yor.reseat_small(sizes, np.full(500, 0.4, np.float32), 0.5, draw)
        assert (sizes.sum(axis=1) == 6).all() and (sizes >= 0).all()
    many = pitman_yor.seat_large(np.array([9, 5000, 100]), np.full(3, 0.4), 0.5, draw)
    assert (many >= 1).all() and (many <= [9, 5000, 100]).all()


# 4 and 7 Searches


def embeddings(spark, n, dims, seed, extra=()):
    draw = np.random.default_rng(seed)
    vecs = [(k, [float(x) for x in draw.standard_normal(dims)], 1) for k in range(n)]
    return spark.createDataFrame([*vecs, *extra], "vec_id long, embedding array<double>, rank int")


ODD = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] + [1.0] * 7, 1), (1060, [None] + [1.0] * 7, 1), (1080, [1.0], 1), (None, [1.0] * 8, 1), (1100, [0.5] * 8, 1), (1100, [0.5] * 8, 1), (1101, [0.5] * 8, 1), (1103, [0.5] * 8, 1)]


def usable(df, zero):
    return [(r.vec_id, np.array(r.embedding)) for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 8 and all(x is not None and math.isfinite(x) for x in r.embedding) and (zero or any(r.embedding))]


def test_ann_recall(spark):
    df = embeddings(spark, 900, 8, 1, ODD)
    got = {}
    for r in ann.search(df, 20, 20, block_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows, hits, total = usable(df, False), 0, 0
    for ident, vec in {i: v for i, v in rows if i % 20 == 0}.items():
        best = sorted(((-float(v @ vec), i) for i, v in rows if i != ident))[:20]
        found = sorted(got[ident])
        assert [f[0] for f in found[:20]] == list(range(1, 21)) or len(found) > 20
        hits, total = hits + len({i for _, i in best} & {f[1] for f in found}), total + 20
    assert hits / total >= 0.9 and not {1000, 1020, 1040, 1060, 1080} & set(got)


def test_ann_recall_at_64(spark):
    """More components than projections, in clusters: recall holds and the stop rule skips leaves."""
    draw = np.random.default_rng(9)
    centres = 4 * draw.standard_normal((40, 64))
    vecs = centres[draw.integers(0, 40, 4000)] + draw.standard_normal((4000, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, 20, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    product = vecs[::20] @ vecs.T
    product[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    best = np.argsort(-product, axis=1)[:, :20]
    assert sum(len(got[20 * q] & set(b.tolist())) for q, b in enumerate(best)) / 4000 >= 0.9


def test_topk_exact(spark):
    df = embeddings(spark, 700, 8, 2, ODD)
    got = {}
    for r in topk.search(df, 50, 5, pivots=9, block_rows=250).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, r.score))
    rows = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(df, True)]
    for ident, vec in {i: v for i, v in rows if i % 50 == 0}.items():
        best = sorted(((-int(v @ vec), i) for i, v in rows if i != ident))[:5]
        assert got[ident] == {(i, -s) for s, i in best}


def test_searches_empty(spark):
    df = embeddings(spark, 0, 8, 1)
    assert ann.search(df, 20, 20).count() == 0 and topk.search(df, 50, 5).count() == 0


def test_chi_square():
    draw = np.random.default_rng(5).standard_normal((200_000, 8))
    point = ann.chi_square_point(0.9, 8)
    assert abs(((draw**2).sum(axis=1) <= point).mean() - 0.9) < 0.005


# 5 Mixing


def test_budgets_siblings_before_ancestors():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}
    weights = {("a",): 1.0, ("b",): 1.0, ("a", "x"): 1.0, ("a", "y"): 1.0, ("b", "z"): 1.0}
    assert mixing.budgets(leaves, 100, weights) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.budgets(leaves, 400, weights) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 290}
    assert mixing.budgets(leaves, 60, weights, epochs=2) == {("a", "x"): 15, ("a", "y"): 15, ("b", "z"): 30}
    assert mixing.budgets({}, 10) == {}


def test_mix_against_brute_force(spark):
    draw = random.Random(1)
    pairs = [(k % 190 if k % 50 else None, "w " * draw.randint(0, 40)) for k in range(300)]
    df = frame(spark, pairs)
    levels = [F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "p").otherwise("q")]
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.e) for r in mixing.mix(df, levels, 0.6, epochs=2, temper=0.3, epoch_column="e", bits=3).collect())
    every = [F.col(f"`{c}`").cast("string") for c in df.columns]
    rows = df.select("*", levels[1].alias("l2"), mixing.words(F.col("text")).alias("n"), F.xxhash64(*every).alias("tie"), *(F.xxhash64(F.lit(17), F.lit(e), F.col("doc_id").cast("string")).alias(f"k{e}") for e in (0, 1))).collect()
    leaves = Counter()
    for r in rows:
        leaves[r.lang, r.l2] += r.n
    given, want = mixing.budgets(dict(leaves), 0.6 * sum(leaves.values()), epochs=2, temper=0.3), Counter()
    for path, budget in given.items():
        own = [r for r in rows if (r.lang, r.l2) == path]
        whole, rest = divmod(budget, leaves[path])
        for e in range(whole):
            want.update((r.doc_id, r.text, r.lang, r.source, e) for r in own)
        peers = {}
        for r in own:
            peers.setdefault((r[f"k{whole}"], r.tie), []).append(r)
        total = 0
        for key in sorted(peers):
            total += sum(r.n for r in peers[key])
            if not rest or total > rest:
                break
            want.update((r.doc_id, r.text, r.lang, r.source, whole) for r in peers[key])
    assert got == want


def test_mix_odd_inputs(spark, docs, none):
    levels = [mixing.domain(F.col("source")), F.col("lang"), F.col("source")]
    assert mixing.mix(none, levels, 0.5).count() == 0
    assert mixing.mix(docs, levels, 1.0).count() == len(TEXTS)
    assert mixing.mix(docs, levels, 0.5).columns == docs.columns


# 6 Token counts, and ids


ODD_TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "é", "'s", "12", "!", "日本", " ", "<|endoftext|>", "▁", "x", "́", "Σ", "İ", "🙂", ".", "\x85", "QUEMENT", "heit"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(ODD_TEXT)
def test_counts_and_ids(text):
    """Counts and ids are the libraries' own, whichever way a text is cut."""
    import sentencepiece
    from tokenizers import Tokenizer

    held = test_counts_and_ids.__dict__.setdefault("held", {})
    if not held:
        held |= {"counter": token_count.Counter(PIECE)} | {(x, "own"): encoding.Encoder(x) for x in (WORD, BYTE)}
        held |= {"p": sentencepiece.SentencePieceProcessor(model_file=PIECE)} | {x: Tokenizer.from_file(x) for x in (WORD, BYTE)}
    assert held["counter"].count(text) == len(held["p"].encode(text))
    for path in (WORD, BYTE):
        assert held[path, "own"].encode(text).tolist() == held[path].encode(text, add_special_tokens=False).ids


COLUMN = st.lists(st.none() | ODD_TEXT | st.lists(st.sampled_from([" ", "\n", "a", "the", " the", "é", "ɏ", "ɐ", "×", "÷", "ª", "'", "'s", "'re", "'ll", "'l", "'ve", "'T", "st", "12", "!", "\n\n", "word" * 7, "<|endoftext|>"]), max_size=20).map("".join), max_size=12)


@settings(max_examples=400, deadline=None)
@given(COLUMN, st.integers(0, 2), st.booleans())
def test_ids_of_columns(texts, skip, large):
    """Texts that are cut by their bytes have the library's ids, in slices of columns and beside texts that are not cut so."""
    held = test_ids_of_columns.__dict__.setdefault("held", {})
    if not held:
        held |= {p: encoding.Encoder(p) for p in (WORD, BYTE)}
    column = pa.array(texts, pa.large_string() if large else pa.string())[skip:]
    for own in held.values():
        assert [x.tolist() for x in own.encode_all(column)] == [own.library.encode(t or "", add_special_tokens=False).ids for t in texts[skip:]]


def test_full_table_and_long_texts(monkeypatch):
    """Ids are right when words share places, when the table is emptied, and when a text is longer than a group."""
    monkeypatch.setattr(encoding, "GROUP", 1 << 10)
    monkeypatch.setattr(encoding, "PLACES", 11)
    own, draw = encoding.Encoder(BYTE), random.Random(2)
    texts = [" ".join("".join(draw.choices("abcdeé", k=draw.randrange(1, 30))) for _ in range(draw.choice([3, 30, 200]))) for _ in range(300)]
    assert [x.tolist() for x in own.encode_all(pa.array(texts))] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_reach_the_model_once():
    """A worker's table holds the words of its texts: 600,000 words that come again are not encoded again."""
    own, calls, n = encoding.Encoder(BYTE), Counter(), 600_000
    model = own.tokenize
    own.tokenize = lambda word: calls.update(n=1) or model(word)
    column = pa.array([" ".join(f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}{chr(97 + d)}{chr(97 + e)}" for e in range(25)) for a in range(4) for b in range(10) for c in range(25) for d in range(24)])
    for _ in range(2):
        assert len(list(own.encode_all(column))) == n // 25
    assert n <= calls["n"] < n * 1.05  # and the words at the start of texts


def test_token_counts_table(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = Counter(map(tuple, token_count.token_counts(docs, PIECE).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    counts = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in TEXTS]
    assert got == Counter((*c, c[2] > 4096) for c in counts)
    assert token_count.token_counts(none, PIECE).count() == 0


# 8 Toxicity


def toxic_tables(spark):
    draw = random.Random(4)
    clean = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(400):
        words = draw.choices(clean, k=draw.randint(5, 120))
        if k % 2:
            for _ in range(1 + len(words) // 30):
                words[draw.randrange(len(words))] = "blarg" + draw.choice(["o", "en", "ix", "um"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, k % 2))
    return frame(spark, [*rows, (None, None), (9001, ""), (9002, "w1 " * 5000)]), spark.createDataFrame([*labels, (None, 1, 1), (9001, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    known = {k: k % 2 for k in range(400)}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.95
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_learns_from_all_windows():
    """The toxic passage of every text lies in the third of 41 windows alone."""
    draw = random.Random(6)
    texts = [draw.choices([f"w{k}" for k in range(200)], k=1300) for _ in range(60)]
    for words in texts[::2]:
        words[81:95] = ["blarg" + draw.choice(["o", "en", "ix", "um"]) for _ in range(14)]
    scores = toxicity.Scorer(toxicity.fit([" ".join(w) for w in texts], [1, 0] * 30)).scores([" ".join(w) for w in texts])
    assert min(scores[::2]) > 0.7 > max(scores[1::2])


def test_toxicity_degenerate(spark, none):
    docs, labels = toxic_tables(spark)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_windows_hold_every_word():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        assert set(range(n)) == {k for a, b in toxicity.windows(n) for k in range(a, b)}


def test_gradients():
    net = toxicity.Network(1, dim=3, hidden=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    inputs, at, lengths, label = r.standard_normal((6, 3)), np.array([[1, 2, 3, 0], [4, 5, 1, 2]]), np.array([3, 4]), np.array([1.0, 0.0])
    g = net.gradients(inputs, at, lengths, label, np.ones(2))
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * label - 1) * net.run(net.gates(inputs), at, lengths)))))
    for name in ("hf", "xb", "a", "out", "cb"):
        w = net.w[name]
        where = (0,) * w.ndim
        held = w[where]
        w[where] = held + 1e-3
        up = loss()
        w[where] = held - 1e-3
        down = loss()
        w[where] = held
        assert abs((up - down) / 2e-3 - g[name][where]) < 2e-3


# 9 SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(pairs):
    ids = list(range(len(pairs)))
    prints = [plain_fingerprint(t) for _, t in pairs]

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                ids[max(x, y)] = min(x, y)
    return prints, [find(k) for k in range(len(pairs))]


def near_texts():
    draw = random.Random(6)
    words = [f"v{k}" for k in range(50)]
    out = []
    for k in range(12):
        base = draw.choices(words, k=150)
        for _ in range(6):
            copy = list(base)
            copy[draw.randrange(150)] = "changed"
            out.append((len(out), " ".join(copy)))
    return [*out, *((500 + k, t) for k, (_, t) in enumerate(TEXTS)), (None, "lost id")]


def test_near_duplicates(spark):
    pairs = near_texts()
    prints, roots = classes(pairs)
    least = {}
    for (i, _), r in zip(pairs, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = Counter(map(tuple, simhash.near_duplicates(frame(spark, pairs)).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(pairs, prints, roots))


def test_tiles_lose_no_links(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, 6).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 6).astype(np.uint64)) for _ in range(40)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = [{(r.node, r.root) for r in simhash.components(simhash.links(df, tile=t)).collect()} for t in (7, 4096)]
    assert found[0] == found[1] and found[0]


def test_keep_one(spark, none):
    pairs = near_texts()
    _, roots = classes(pairs)
    kept = simhash.keep_one(frame(spark, pairs))
    assert kept.count() == len(set(roots)) and kept.columns == frame(spark, pairs).columns
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


# 10 Wavelet matrices


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=80))
def test_wavelet_support(values):
    ids = np.array(values, np.uint16)
    shard = wavelet.Shard(wavelet.pack_shard(ids, [None], np.array([len(ids)]), 16))
    assert shard.ids().tolist() == values and shard.docs == [None]
    for k, v in enumerate(values[:20]):
        assert shard.access(k) == v
        assert shard.rank(v, k + 1) == values[: k + 1].count(v)
        assert shard.select(v, values[: k + 1].count(v) - 1) == k
    assert shard.rank(50_000) == values.count(50_000)


def test_wavelet_table(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, wavelet.read_shards(wavelet.write_shards(docs, BYTE, shard_tokens=500)).select("start", "doc_id", "n_tokens", F.crc32("ids").alias("c")).collect()))
    at, want = 0, []
    for doc, text in sorted(TEXTS, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((at, doc, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert wavelet.read_shards(wavelet.write_shards(none, BYTE)).count() == 0


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "source mixing", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert set(docs.columns) == set(SCHEMA.names) | set(CLASH)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert packed and check_packed(packed, 2048) <= len(packed)
    assert not {r.doc_id for r in packed if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

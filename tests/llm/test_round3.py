"""Cutting-stock packing, whitening and lexical search against plain versions, and on odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import lexical_search, queries, stock_packing, whitening
from lodestrand.llm.packing import vocabulary_path

LETTERS = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, texts, capacity, waste):
    """Every id lies once, in order, in a piece whose checksum is right; sequences are gapless and not padded but by ``waste``."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = Counter((d, tuple(ids_of(t))) for d, t in texts)
    for (d, ids), times in want.items():
        own = sorted(by_doc[d], key=lambda r: r["start"])
        assert len(ids) * sum(n for (x, _), n in want.items() if x == d) == sum(r["length"] for r in own) or times == 1
        if sum(n for (x, _), n in want.items() if x == d) > 1:
            continue
        at = 0
        for r in own:
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 or at == capacity else capacity - at
    assert padded <= waste
    return by_seq


@pytest.mark.parametrize("capacity", [2048, 16, 10])
def test_stock_packing(spark, capacity):
    words = ["the", "cat", "of", "antidisestablishmentarianism", "x!", "Ünïcode", "<|endoftext|>"]
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(120)] + [(200, None), (201, ""), (202, "the " * 5000), (203, " ")]
    df = spark.createDataFrame([(d, t, 7, "s") for d, t in texts], "doc_id long, text string, length long, pid string").repartition(5)
    rows = stock_packing.pack(df, capacity=capacity).collect()
    # sums that aren't powers of two occur where the capacity isn't one: only the tape's last part
    check_packing(rows, texts, capacity, 0)


def test_stock_packing_of_equal_and_of_no_rows(spark):
    same = [(k // 2, "the cat") for k in range(4000)]
    rows = stock_packing.pack(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sum(r["length"] for r in rows) == 12_000 and len(check_packing([r for r in rows], [], 2048, 0)) <= 12_000 // 2048 + 11
    assert stock_packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("low,high,n", [(1, 40, 2000), (700, 1400, 1500), (1100, 1100, 500), (1, 2048, 20000), (2048, 2048, 20), (1, 2048, 300), (1, 1, 5000)])
def test_patterns_fill_sequences_and_keep_every_piece(low, high, n):
    lengths = np.random.default_rng(1).integers(low, high + 1, n)
    demand = {int(x): int(k) for x, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    found, tape = stock_packing.patterns(demand)
    used = Counter(tape)
    for pattern, times in found:
        assert sum(x * k for x, k in pattern.items()) in stock_packing.free_sums(2048) and times > 0
        used.update({x: k * times for x, k in pattern.items()})
    assert used == Counter(demand)
    if (low, high) == (1, 2048) and n == 20000:
        assert sum(x * k for x, k in tape.items()) < 0.2 * lengths.sum()  # a tight case: each sequence has room for one long piece


def test_the_basis_is_inverted_and_pivots_keep_it(monkeypatch):
    lengths = np.random.default_rng(5).integers(100, 900, 400)
    demand = {int(x): int(k) for x, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    m = stock_packing.Master(demand, 1024, [p for p, _ in stock_packing.fill(demand, 1024)[0]])
    rng = np.random.default_rng(0)
    for turn in range(40):
        basis = np.eye(len(m.lengths))
        for row, pattern in enumerate(m.basis):
            if pattern is not None:
                basis[:, row] = 0
                for length, k in pattern.items():
                    basis[m.at[length], row] = k
        assert np.abs(basis @ m.inverse - np.eye(len(basis))).max() < 1e-6
        assert np.abs(basis @ m.level - m.need).max() < 1e-6 and m.level.min() >= 0
        before = m.tape_and_more()
        stock_packing._price(m, sorted(rng.choice(len(m.lengths), 60, replace=False).tolist()), demand)
        assert m.tape_and_more() <= before + 1e-9


def plain_white(vectors, most):
    good = [(k, np.array([math.floor(64 * float(c)) for c in v], object)) for k, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(x) for _, x in good).most_common(1)[0][0]
    good = [(k, x) for k, x in good if len(x) == size]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, total = len(fit), [sum(int(x[i]) for x in {tuple(y) for _, y in good}) for i in range(size)]
    cov = np.cov(fit.T, bias=True).reshape(size, size)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return good, n, total, values[order], vecs[:, order], np.trace(cov)


def test_whitening_equals_a_plain_version(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6)) * [3, 2, 1, 0.5, 0.3, 0.2]
    vectors = [(k, (rng.normal(size=6) @ mix).tolist()) for k in range(300)]
    vectors += [(k, vectors[0][1]) for k in range(300, 420)] + [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [math.nan] + [0.0] * 5), (504, [math.inf] + [0.0] * 5), (505, [1.0, 2.0]), (0, [0.25] * 6)]
    df = spark.createDataFrame([(k, v, 1) for k, v in vectors], "vec_id long, embedding array<float>, component int").repartition(3)
    vectors = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in vectors]
    good, n, total, values, vecs, trace = plain_white(vectors, 4)
    got = defaultdict(dict)
    for r in whitening.whiten(df, components=4).collect():
        got[r["id"], r["deviation"]][r["component"]] = r
    assert len(got) == len({(k, tuple(x)) for k, x in good})
    for k, x in good:
        z = [n * int(c) - s for c, s in zip(x, total, strict=True)]
        own = got[k, sum(c * c for c in z)]
        for c in range(4):
            plain = np.array([v / n for v in z]) @ vecs[:, c] / math.sqrt(values[c])
            r = own[c + 1]
            assert abs(abs(r["whitened"]) - abs(plain)) < 1e-8 and r["n"] == n and r["identity_error"] < 1e-9
            assert abs(r["explained"] - values[c] / trace) < 1e-12
    signs = {c: {np.sign(own[c + 1]["whitened"]) * np.sign(np.array([n * int(v) - s for v, s in zip(x, total, strict=True)]) / n @ vecs[:, c]) for (k, x) in good for own in [got[k, sum((n * int(v) - s) ** 2 for v, s in zip(x, total, strict=True))]] if abs(own[c + 1]["whitened"]) > 1e-6} for c in range(4)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1e300, 0.0])])).collect()
    assert {r["component"] for r in rows} == {1} and all(math.isfinite(r["whitened"]) for r in rows)


@pytest.mark.parametrize("top", [100, 1 << 20, 1 << 40, 1 << 52])
def test_sums_of_squares_are_exact(top):
    w = np.random.default_rng(0).integers(-top, top, (1000, 3))
    w[0] = [top, -top, 0]
    assert whitening.square_sums(w, top) == [sum(int(x) ** 2 for x in w[:, c]) for c in range(3)]


def plain_search(docs, items, top):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if ord(c) > 127 or c in LETTERS else " " for c in low).split(" ")

    bags = [(d, Counter(t for t in terms(text) if t)) for d, text in docs]
    count, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * count) // max(1, length)
            score = sum(times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t, times in Counter(x for x in terms(text) if x).items() if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [lexical_search.HELD, 200])
def test_lexical_search_equals_a_plain_version(spark, monkeypatch, held):
    monkeypatch.setattr(lexical_search, "HELD", held)
    rng = np.random.default_rng(4)
    words = ["A", "b", "ÄÖ", "c3", "the", "The", "x\x00y", "ø", "zz", " q"] + [f"w{k}" for k in range(30)]
    text = lambda n: "".join(w + s for w, s in zip(rng.choice(words, n), rng.choice([" ", ", ", "\n", "-", "_"], n), strict=True))
    docs = [(k, text(rng.integers(1, 80))) for k in range(200)] + [(None, "the b b"), (7, "b"), (300, None), (301, ""), (302, "..."), (303, "the " * 30_000)] + [(400 + k, "same words w1 w2") for k in range(30)]
    items = [(k, text(rng.integers(1, 40))) for k in range(12)] + [(50, "same words"), (51, None), (52, ""), (53, "nowhere"), (54, "b b b the the"), (None, "w1 w2"), (50, "zz")]
    d = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, n int, score int").repartition(4)
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, rank int")
    for blocks in (lexical_search.BLOCK_PAIRS, 300):
        monkeypatch.setattr(lexical_search, "BLOCK_PAIRS", blocks)
        got = sorted((tuple(r) for r in lexical_search.search(d, i).collect()), key=str)
        assert got == plain_search(docs, items, 10)


def test_a_plan_sums_each_item_and_shares(spark):
    rng = np.random.default_rng(1)
    items = [Counter(rng.choice([f"t{k}" for k in range(25)], rng.integers(1, 40)).tolist()) for _ in range(15)] + [Counter({"t1": 5, "t2": 1})] * 2
    graph = lexical_search.plan(items)
    value = {t: 3**k for k, t in enumerate(graph.terms)}
    nodes = [value[graph.terms[t]] * times for t, times in graph.leaves]
    for members in graph.sums:
        nodes.append(sum(nodes[m] for m in members))
    assert [sum(nodes[m] for m in top) for top in graph.tops] == [sum(value[t] * n for t, n in item.items()) for item in items]
    additions = sum(len(m) - 1 for m in graph.sums) + sum(len(t) - 1 for t in graph.tops)
    assert additions < 0.8 * sum(sum(bin(n).count("1") for n in item.values()) - 1 for item in items)
    pairs = Counter(p for top in graph.tops for k, a in enumerate(top) for p in ((a, b) for b in top[k + 1 :]))
    assert max(pairs.values(), default=0) < 2  # no two items still share a pair


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(some, items.limit(0)).count() == 0
    assert lexical_search.search(some, items).select("rank", "doc_id").collect() == [(1, 1)]


def test_the_three_queries(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check_packing(queries.op11_stock_packing(spark, sf_dir).collect(), docs, 2048, 0)
    assert sorted((tuple(r) for r in queries.op13_lexical_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(docs, items, 10)
    white = queries.op12_embedding_whitening(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert white.groupBy("component").count().where(F.col("count") != n).count() == 0 and white.agg(F.max("identity_error")).first()[0] < 1e-9

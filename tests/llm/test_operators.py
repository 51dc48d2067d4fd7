"""Each operator against a plain version of itself, over texts that are null, empty, long, repeated or odd."""

import bisect
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrand.llm import components, decontam, embed_dedup, langid, license_scan, packing, quality, sharding, simhash, substring, token_count

#: Extra columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, strip long, w string, h long, rank int, id string, label string"
_random = random.Random(5)
_VOCABULARY = ["the", "of", "and", "Alpha", "beta,", "gamma.", "été", "straße", "ñandú", "x1", "—", "Über"]


def prose(n, words=_VOCABULARY, rng=_random):
    return " ".join(rng.choice(words) for _ in range(n))


_LONG = prose(3000)
_PASSAGE = prose(40)
TEXTS = [
    None, "", "   ", "word", "two words", "İstanbul'da ΣΑΣ ﬁ é  x y", "a\tb\x0bc\x1fd\x85e\r\nf", _LONG, _LONG, _LONG + " tail", "12 34 !!", "\U0001f600 \U0001f600",
    _PASSAGE, prose(5) + " " + _PASSAGE + " " + prose(6), _PASSAGE + " " + _PASSAGE, prose(19), prose(20), "x" * 5000, "same same " * 60, "Released under the MIT License.\n\nThe end.",
]


def rows_of(texts):
    return [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", 1, 7, 8, "w", 9, 1, "i", None) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(TEXTS)
    return spark.createDataFrame([*rows, rows[12], (None, _PASSAGE, None, None, None, None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def all_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# ---- 1


_ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return _ITEM_WORD.findall(low)


def plain_scan(docs, items):
    marks = {}
    for item, text in items:
        w = item_words(text)
        for s in [tuple(w)] if 0 < len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)]:
            if item is not None:
                marks.setdefault(s, set()).add(str(item))
    out = []
    for doc, text in docs:
        w, found = item_words(text), set()
        hit = [0] * len(w)
        for size in {len(m) for m in marks}:
            for k in range(len(w) - size + 1):
                if (s := tuple(w[k : k + size])) in marks:
                    hit[k : k + size] = [1] * size
                    found |= marks[s]
        out.append((doc, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


ITEMS = [(1, _PASSAGE), (2, " ".join(_PASSAGE.split()[5:14])), (3, "two words"), (10, "WORD"), (4, None), (5, "?!"), (None, "word"), (6, prose(12)), (7, "same same same same same same same same same same")]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, docs, empty, broadcast):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = decontam.scan(docs, items, broadcast_windows=broadcast)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()), key=repr) == plain_scan(all_rows(docs), ITEMS)
    assert decontam.scan(empty, items, broadcast_windows=broadcast).count() == 0
    nothing = decontam.scan(docs, items.limit(0), broadcast_windows=broadcast)
    assert nothing.count() == docs.count() and nothing.agg({"n_hit": "sum"}).first()[0] == 0
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("doc", "tkey", "hit", "item_id", "print", "d")))
    kept = decontam.drop_contaminated(clash, items)
    assert kept.columns == clash.columns
    assert collected(kept, "doc_id") == sorted(((d,) for d, _, n, _ in plain_scan(all_rows(docs), ITEMS) if not n), key=repr)


# ---- 2


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.7
    accuracy = [0.9, 0.8, 0.75, 0.5, 0.85]
    votes = []
    for t in truth:
        votes.append("".join("2" if rng.random() < 0.2 else str(int(t if rng.random() < a else not t)) for a in accuracy))
    counts = {v: votes.count(v) for v in set(votes)}
    model = quality.fit_label_model(counts)
    assert abs(model.prior - truth.mean()) < 0.05
    for k, a in enumerate(accuracy):
        assert abs(model.table[k, 1, 1] - a) < 0.07
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_quality(spark, docs, empty, sf_dir):
    found = quality.classify(docs)
    assert found.count() == docs.count()
    blank = [r for r in found.collect() if r["doc_id"] in (0, 1, 2)]
    assert all(r["score"] == 0 and not r["keep"] for r in blank)
    assert quality.classify(empty).count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in scored) / len(scored) > 0.93
    assert all(r["keep"] for r in scored if r["quality"] == 1)


def test_label_model_is_expectation_maximisation():
    """Against the same steps written out for each document."""
    rng = random.Random(1)
    votes = ["".join(rng.choice("01122") for _ in range(4)) for _ in range(300)]
    counts = {v: votes.count(v) for v in set(votes)}
    p = [(v.count("1") + 0.5) / (v.count("0") + v.count("1") + 1) for v in votes]
    for _ in range(100):
        prior = min(0.98, max(0.02, sum(p) / len(p)))
        table = {}
        for k in range(4):
            for c in (0, 1):
                n = [1 + sum(q if c else 1 - q for v, q in zip(votes, p, strict=True) if v[k] == str(x)) for x in (0, 1)]
                table[k, c] = [x / sum(n) for x in n]
            if table[k, 1][1] * table[k, 0][0] < table[k, 0][1] * table[k, 1][0]:
                table[k, 0] = table[k, 1] = [(a + b) / 2 for a, b in zip(table[k, 0], table[k, 1], strict=True)]
        new = []
        for v in votes:
            w = [1 - prior, prior]
            for k, x in enumerate(v):
                if x != "2":
                    w = [w[c] * table[k, c][int(x)] for c in (0, 1)]
            new.append(w[1] / sum(w))
        done = max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-6
        if done:
            break
        p = new
    assert np.allclose(quality.fit_label_model(counts).posterior(votes), new, atol=1e-5)


def test_quality_is_the_same_again_where_rows_repeat(spark):
    rows = [(k % 50, prose(3 + k % 50)) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality.classify(table.repartition(n), sample=20).groupBy("doc_id").agg(F.round(F.sum("score"), 9).alias("s")) for n in (1, 5))
    assert collected(a, "doc_id", "s") == collected(b, "doc_id", "s")


# ---- 3


def test_cover_tree_and_components(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows, k = [], 0
    for b in base:
        for _ in range(14):
            rows.append((k, (b + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.12, 0.3])).astype(np.float32).tolist(), int(k % 2), "x"))
            k += 1
    rows += [(k, None, 1, "x"), (k + 1, [0.0] * 8, 1, "x"), (k + 2, [float("inf")] + [1.0] * 7, 1, "x"), (k + 3, [None] + [1.0] * 7, 1, "x"), (k + 4, rows[0][1], None, "x"), (k + 5, rows[0][1][:4], 0, "x"), (k + 6, [], 0, "x"), (None, rows[0][1], 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    good = [(i, np.array(v, float), lab) for i, v, lab, _ in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {r[0]: 0 for r in rows}
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    expected = sorted(((r[0], links[r[0]], None if r[0] is None else root(r[0])) for r in rows), key=repr)
    for tile in (2048, 16):
        assert collected(embed_dedup.embedding_groups(table, tile=tile), "vec_id", "n_links", "component") == expected
    assert sum(links.values()) > 100
    assert embed_dedup.embedding_groups(table.limit(0)).count() == 0


def test_cells_far_apart_send_no_guests(spark):
    rng = np.random.default_rng(5)
    counts = []
    for n in (512, 1024):
        middle = np.linalg.qr(rng.normal(size=(16, 16)))[0][:8]
        rows = [(k, (middle[k % 8] + 0.02 * rng.normal(size=16)).tolist(), 1, 1, 16) for k in range(n)]
        reps = spark.createDataFrame(rows, "rep long, v array<double>, weight long, label int, dim int")
        tasks = embed_dedup.cell_tasks(reps, tile=n // 8)
        assert tasks.where("kind = 1").count() == 0
        counts.append(tasks.count())
    assert counts[1] < 2.5 * counts[0]


def test_huge_and_tiny_vectors_link(spark):
    rows = [(0, [1e300, 1e300], 1), (1, [1e-300, 1e-300], 1), (2, [5e-324, 5e-324], 1), (3, [1e300, -1e300], 1)]
    found = embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert collected(found, "vec_id", "n_links", "component") == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]


def test_connected_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    found = components.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert collected(found, "node", "root") == sorted(((x, root(x)) for x in up if root(x) != x), key=repr)


# ---- 4


def plain_cut(rows, window):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if (k := tuple(w[i : i + window])) in seen:
                gone[i : i + window] = [True] * window
            else:
                seen.add(k)
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "strip"), [(20, 8 << 20), (20, 2000), (6, 3000), (4, 500)])
def test_substring_dedup(docs, empty, window, strip):
    found = substring.remove_repeats(docs, window=window, strip_bytes=strip)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_text") == plain_cut(all_rows(docs), window)
    assert substring.remove_repeats(empty, window=window).count() == 0


def test_substring_dedup_of_any_ids_and_names(spark):
    rng = random.Random(4)
    passage = prose(30, rng=rng)
    rows = [(f"id{rng.randrange(6)}" if k % 7 else None, f"{prose(rng.randrange(40), rng=rng)} {passage if k % 3 else ''}", k, "n", "s") for k in range(40)] + [("id1", None, 1, "n", "s"), ("id1", prose(2000, rng=rng), 1, "n", "s")]
    table = spark.createDataFrame(rows, "doc_id string, text string, n_words int, kept_text string, strip string").repartition(4)
    found = substring.remove_repeats(table, strip_bytes=1000)
    assert found.columns == ["doc_id", "text", "strip", "n_words", "n_removed", "kept_text"]
    plain, seen = [], set()
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, (r[1] or "").encode())):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if (k := tuple(w[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        plain.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(plain, key=repr)


def test_substring_strips_are_cut_by_bytes(spark):
    rows = [(k % 2, prose(30)) for k in range(300)]
    strips = substring._strips(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", [], 60_000, 5_000).collect()
    sizes = [substring._unpack(r["rows"])["text"].nbytes for r in strips]
    assert len(sizes) > 5 and max(sizes) < 8_000


def test_substring_dedup_many_strips(spark):
    rng = random.Random(11)
    shared = [prose(30, rng=rng) for _ in range(4)]
    rows = [(k, " ".join([prose(rng.randrange(0, 60), rng=rng), rng.choice(shared), prose(rng.randrange(0, 30), rng=rng)])) for k in range(120)]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=20, strip_bytes=1500)
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_text") == plain_cut(rows, 20)


# ---- 5


def test_token_pieces_are_the_tokenizer_s(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    expected = []
    for doc, text in all_rows(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected += [(doc, i // 500, i, len(ids[i : i + 500]), zlib.crc32(np.array(ids[i : i + 500], "<u4").tobytes())) for i in range(0, len(ids), 500)]
    assert collected(packing.token_pieces(docs, capacity=500), "id", "piece", "start", "length", "crc") == sorted(expected, key=repr)


def test_word_ids_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(packing.vocabulary_path()), packing.WordIds(packing.vocabulary_path())
    texts = ["it's we'll 'sup", "a.b,c!", "end.”", "été. İx.", "x​y", "ǅ ß ſt", "a b.", "<|endoftext|> a<|startoftext|>b", "<|EndOfText|> X<|endoftext|>Y.", "don't.", "1,000.50", "abc...!?", "...", "naïve.", "日本語。テスト", "́.", "KK."]
    for _ in range(2):
        assert [x.tolist() for x in own(pa.array(texts, pa.string()))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_best_fit(spark, docs, empty):
    rng = random.Random(2)
    rows = [(k, 0, 0, rng.choice([rng.randrange(1, 4097), rng.randrange(1, 300), 2048, 700]), k) for k in range(3000)]
    packed = packing.best_fit(spark.createDataFrame(rows, "id long, piece int, start long, length long, crc long")).collect()
    assert sorted((r["id"], r["length"]) for r in packed) == sorted((r[0], r[3]) for r in rows)
    assert check_packed(packed, 4096) <= -(-sum(r[3] for r in rows) // 4096) * 1.01
    assert check_packed(packing.pack(docs, capacity=64).collect(), 64) > 0
    assert packing.pack(empty).count() == 0


def plain_best_fit(lengths, capacity):
    """Best fit, longest first: the number of sequences."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        if gap > length:
            bisect.insort(gaps, gap - length)
    # sequences are full, or hold a gap: their number follows from the volume
    return -(-(sum(lengths) + sum(gaps)) // capacity)


@pytest.mark.parametrize(("low", "high", "n"), [(1, 4096, 400), (1300, 2100, 300), (1, 40, 2000), (4096, 4096, 20), (2000, 2060, 101), (700, 1400, 1500), (700, 1400, 300), (900, 1400, 600)])
def test_sequences_are_as_few_as_those_of_plain_best_fit(spark, low, high, n):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(n)]
    rows = [(k, 0, 0, x, k) for k, x in enumerate(lengths)]
    packed = packing.best_fit(spark.createDataFrame(rows, "id long, piece int, start long, length long, crc long")).collect()
    assert check_packed(packed, 4096) <= plain_best_fit(lengths, 4096) + 1


@pytest.mark.parametrize("bin_rows", [500_000, 3])
def test_a_superstep_gives_each_piece_the_smallest_gap_left(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(packing, "ROWS_A_BIN", bin_rows)
    rng = random.Random(9)
    pieces, gaps = [(k, rng.randint(65, 80)) for k in range(200)], [(k, rng.randint(20, 87)) for k in range(150)]
    opens, closes = ({x: [v for _, v in rows].count(x) for x in {v for _, v in rows} if x > 64} for rows in (gaps, pieces))
    starts, n, volume = packing.depths(opens, closes)
    slots = packing._slots(spark.createDataFrame(gaps, "seq long, gap long"), 64, 128)
    found = packing.superstep(spark.createDataFrame(pieces, "pid long, length long"), slots, spark.createDataFrame(starts, "size long, kind int, start long"), 200).collect()
    free, expected = sorted(g for _, g in gaps if g > 64), []
    for _, length in sorted(pieces, key=lambda p: -p[1]):
        at = bisect.bisect_left(free, length)
        expected.append((length, free.pop(at) if at < len(free) else None))
    assert sorted(((r["length"], r["gap"]) for r in found), key=repr) == sorted(expected, key=repr)
    taken = [r["seq"] for r in found if r["seq"] is not None]
    assert len(taken) == len(set(taken)) and sorted(r["pid"] for r in found) == list(range(200))
    assert (n, volume) == (sum(g is None for _, g in expected), sum(x for x, g in expected if g is None))


def test_bands_hold_each_length_once():
    for capacity in (1, 7, 64, 500, 4096):
        assert sorted(x for low, high in packing.bands(capacity) for x in range(low + 1, high + 1)) == list(range(1, capacity + 1))


# ---- 6


def groups(ids, prints, radius=2):
    up = {k: k for k in range(len(ids))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = root(k)
            least[r] = min(i, least.get(r, i))
    return [least.get(root(k)) for k in range(len(ids))]


def plain_fingerprint(text):
    """By the definition, a bit at a time."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = all_rows(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    parts = groups([d for d, _ in rows], prints)
    expected = sorted(((d, p - (1 << 64) if p >> 63 else p, c) for (d, _), p, c in zip(rows, prints, parts, strict=True)), key=repr)
    assert collected(simhash.simhash_groups(docs), "doc_id", "fp", "component") == expected
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id") == sorted({(c,) for c in parts}, key=repr)


def test_keep_one_by_row_where_ids_are_null_or_repeated(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue white", "lorem ipsum dolor sit amet")
    assert all((simhash.fingerprint(x.encode().split()) ^ simhash.fingerprint(y.encode().split())).bit_count() > 2 for x in (a, b, c, d) for y in (a, b, c, d) if x != y)
    rows = [(None, a, "n1"), (None, b, "n2"), (None, b, "n2"), (1, c, "r1"), (0, c, "r0"), (1, d, "r2"), (None, d, "n3"), (2, None, "e2"), (2, "", "e3")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["text"]), key=repr) == sorted([(None, a), (None, b), (0, c), (1, d)], key=repr)
    assert [r["doc_id"] for r in kept if not r["text"]] == [2]
    assert all(tuple(r) in rows for r in kept)


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_links_span_all_pairs(spark, tile):
    rng = random.Random(4)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(20):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=tile)
    roots = dict(collected(components.connected_components(links), "node", "root"))
    expected = groups(signed, values)
    mine = [roots.get(v, v) for v in signed]
    assert len(set(zip(mine, expected, strict=True))) == len(set(mine)) == len(set(expected))


# ---- 7


def test_sharding(docs, empty):
    found = sharding.interleave(docs, shards=4).collect()
    texts = {d: t for d, t in all_rows(docs)}
    assert len(found) == docs.count()
    by = {}
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 4
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.interleave(empty).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(k, "t", "hot" if k % 3 else f"s{k % 7}") for k in range(2000)]
    found = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).groupBy("source", "shard").count().collect()
    for source in {r["source"] for r in found}:
        own = [r["count"] for r in found if r["source"] == source]
        assert len(own) == 8 and max(own) - min(own) <= 4  # a cut falls by rows of all sources


# ---- 8


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(0)
    offsets = np.array([0, 1, 4, 68, 132, 400])
    e, moves = rng.normal(size=(400, 3)).astype(np.float32) * 2, rng.normal(size=(3, 3))
    found = langid.marginals(e, offsets, moves)
    a = np.exp(moves)
    for s, t in zip(offsets[:-1], offsets[1:], strict=True):
        b = np.exp(e[s:t].astype(float))
        alpha, beta = np.zeros_like(b), np.ones_like(b)
        alpha[0] = (np.full(3, 1 / 3) @ a) * b[0]
        for k in range(1, t - s):
            alpha[k] = (alpha[k - 1] @ a) * b[k]
            alpha[k] /= alpha[k].sum()
        for k in range(t - s - 2, -1, -1):
            beta[k] = a @ (b[k + 1] * beta[k + 1])
            beta[k] /= beta[k].sum()
        g = alpha * beta
        assert np.allclose(found[s:t], g / g.sum(axis=1, keepdims=True), atol=1e-6)


def test_language_id(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, test = table.where("doc_id % 4 <> 2"), table.where("doc_id % 4 = 2")
    field = langid.fit_on(train)
    found = langid.label_documents(test, field).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("lang_pred", "score", "shares")))
    labelled = langid.label_documents(clash, field)
    assert labelled.columns == [*docs.columns, "lang_pred", "score", "shares"] and labelled.where("lang_pred = 'x'").count() == 0
    odd = {r["doc_id"]: r for r in langid.label_documents(docs, field).collect()}
    assert {k for k, r in odd.items() if r["lang_pred"] == "und"} >= {0, 1, 2, 10, 11} and all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.label_documents(empty, field).count() == 0
    switched = spark.createDataFrame([(0, found[0]["text"][:400] + " " + next(r["text"] for r in found if r["lang"] != found[0]["lang"])[:400])], "doc_id long, text string")
    shares = langid.label_documents(switched, field).first()["shares"]
    assert sorted(shares.values())[-2] > 0.2


# ---- 9


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram(token_count.vocabulary(), 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    expected = sorted(((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in all_rows(docs)), key=repr)
    assert collected(token_count.count_tokens(docs), "doc_id", "n_tokens") == expected
    assert token_count.count_tokens(empty).count() == 0


def test_count_ties():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("▁", -1.0), ("▁a", -2.0), ("aba", -3.0)]
    from tokenizers import Tokenizer, models

    tokenizer, own = Tokenizer(models.Unigram(pieces, 0, False)), token_count.PieceCounter(pieces)
    rng = random.Random(0)
    for _ in range(300):
        word = "".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 12)))
        assert own.viterbi(word) == len(tokenizer.encode(word, add_special_tokens=False).ids), word


# ---- 10


def test_license_scan(spark, docs, empty):
    plain = [prose(15) for _ in range(300)]
    model = license_scan.fit(plain)
    texts = [
        ("MIT", "Some text here.\nReleased under the MIT License.\nMore."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "x\n\n\nThis work is licensed under the GNU General Public License, version 3."),
        ("CC-BY-NC", "LICENSED UNDER CC BY-NC 4.0."), ("BSD", "See below.\nLicensed under the BSD 3-Clause License."), ("", "The license of the driver was lost."), ("", prose(30)), ("", None), ("", ""), ("unknown", "Released under the Example Community License, version 9."),
    ]
    table = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(table, model).collect()}
    assert [",".join(found[k]["licences"]) for k in range(len(texts))] == [name for name, _ in texts]
    assert found[2]["n_paragraphs"] == 2 and found[2]["found"][0]["paragraph"] == 1
    odd = {r["doc_id"]: r for r in license_scan.scan(docs, model).collect()}
    assert [k for k, r in odd.items() if r["licences"]] == [19] and odd[19]["licences"] == ["MIT"]
    assert license_scan.scan(empty, model).count() == 0 and license_scan.fit_on(empty).classes[0] == "none"


def test_license_recall_and_precision_on_planted_lines(spark, sf_dir):
    """Notices with holders, years and other words, planted at random places of the given texts; what is there already counts by a plain pattern."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, rng = license_scan.fit_on(docs), random.Random(8)
    own = re.compile(r"licen[sc]e|public domain|copyright|spdx", re.IGNORECASE)
    texts = [r["text"] for r in docs.select("text").collect() if r["text"] and not own.search(r["text"])]
    rows, planted = [], {}
    for k, text in enumerate(texts):
        if k % 3 == 0:
            name = rng.choice(list(license_scan.TEMPLATES))
            lines = text.split("\n")
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "Note. ", "Copyright (c) 2019 The Authors. "]) + rng.choice(license_scan.TEMPLATES[name]) + rng.choice(["", " See the file for details."]))
            text, planted[k] = "\n".join(lines), name
        rows.append((k, text))
    found = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    right = sum(name in found[k] for k, name in planted.items())
    said = sum(len(x) for x in found.values())
    assert right / len(planted) > 0.95 and right / said > 0.95, (right, len(planted), said)


def test_the_unknown_class_decides(spark, sf_dir):
    model = license_scan.fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = [
        (["unknown"], "Licensed under the terms of the vendor agreement. SPDX-License-Identifier: MIT"), (["unknown"], "This software is not released under the MIT License; all rights reserved"),
        (["unknown"], "You may not use this work under the GNU GPL v3; all rights reserved."), (["MIT", "unknown"], "Released under the MIT License.\nLicensed under the terms of the vendor agreement."),
        (["unknown"], "It may not be licensed under the Apache License, Version 2.0 without a written agreement"), (["MIT"], "Copyright (c) 2019 The Authors. SPDX-License-Identifier: MIT See the file for details."),
    ]
    found = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert [found[k] for k in range(len(texts))] == [x for x, _ in texts]


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("width", [20, 40, 80])
def test_license_scan_of_wrapped_notices(spark, width, mark):
    model = license_scan.fit([prose(15) for _ in range(300)])
    notices = [(name, t) for name, own in license_scan.TEMPLATES.items() for t in own if len(t) > width]
    blocks = ["\n".join(mark + x for x in textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)) for _, t in notices]
    rng, around = random.Random(2), []
    for b in blocks:
        around += [b, f"{prose(30, rng=rng)}\n\n{b}\n\n{prose(30, rng=rng)}", f"{mark}{prose(8, rng=rng)}\n{b}\n{mark}{prose(8, rng=rng)}"]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(around)), "doc_id long, text string"), model).collect()}
    wrong = [(name, k % 3, found[k]["licences"]) for k, (name, _) in enumerate(n for n in notices for _ in range(3)) if found[k]["licences"] != [name]]
    assert not wrong, wrong
    assert all(found[k]["n_paragraphs"] == (3 if k % 3 == 1 else 1) for k in found)


def test_digest_of_kept_words(docs):
    found = substring.remove_repeats(docs).select("doc_id", F.sha2(F.col("kept_text").cast("binary"), 256).alias("d"))
    assert collected(found, "doc_id", "d") == sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, _, _, t in plain_cut(all_rows(docs), 20)), key=repr)

"""The registered queries' own columns against their contracts on the smallest tables."""

import hashlib
import zlib

from lodestrand.llm import queries

from .test_operators import groups, plain_cut, plain_fingerprint, plain_scan


def tables(spark, sf_dir, name, *columns):
    return [tuple(r[c] for c in columns) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def test_decontamination_digest(spark, sf_dir):
    docs, items = tables(spark, sf_dir, "documents", "doc_id", "text"), tables(spark, sf_dir, "benchmark", "item_id", "text")
    found = {r["doc_id"]: r for r in queries.op1_decontamination(spark, sf_dir).collect()}
    for doc, n, hit, ids in plain_scan(docs, items):
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert tuple(found[doc][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == (n, hit, len(ids), digest, hit > 0)


def test_substring_digest(spark, sf_dir):
    found = {r["doc_id"]: r for r in queries.op4_substring_dedup(spark, sf_dir).collect()}
    for doc, n, gone, kept in plain_cut(tables(spark, sf_dir, "documents", "doc_id", "text"), 20):
        assert tuple(found[doc][c] for c in ("n_words", "n_removed", "kept_sha256")) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_simhash_columns(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents", "doc_id", "text")
    prints = [plain_fingerprint(t) for _, t in docs]
    expected = {d: (f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, groups([d for d, _ in docs], prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash_near_dedup(spark, sf_dir).collect()} == expected


def test_sharding_laws(spark, sf_dir):
    docs, rows = dict(tables(spark, sf_dir, "documents", "doc_id", "text")), queries.op7_sharding(spark, sf_dir).collect()
    slots: dict = {}
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_language_hold_out(spark, sf_dir):
    langs = dict(tables(spark, sf_dir, "documents", "doc_id", "lang"))
    rows = queries.op8_language_id(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_quality_recall_and_precision(spark, sf_dir):
    labels = dict(tables(spark, sf_dir, "labels", "doc_id", "quality"))
    rows = [r for r in queries.op2_quality_classifier(spark, sf_dir).collect() if r["doc_id"] in labels]
    bad = [r for r in rows if labels[r["doc_id"]] == 0]
    dropped = [r for r in rows if not r["keep"]]
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.9 and sum(labels[r["doc_id"]] == 0 for r in dropped) / max(1, len(dropped)) > 0.9

"""The pipeline, stage by stage, against plain versions; each stage reads what the one before has written."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from lodestrand.llm import packing, simhash

from .test_operators import check_packed, groups, plain_cut, plain_scan


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = ({r["doc_id"]: r for r in before.collect()}, docs.collect())

    before, after = kept["language_id"]
    assert {r["doc_id"] for r in after} == {k for k, r in before.items() if any(map(str.isalpha, r["text"] or ""))}

    before, after = kept["simhash_near_dedup"]
    ids = sorted(before)
    parts = groups(ids, [simhash.fingerprint((before[k]["text"] or "").encode().lower().split()) for k in ids])
    assert sorted(r["doc_id"] for r in after) == sorted(set(parts))
    assert all(r == before[r["doc_id"]] for r in after)

    before, after = kept["substring_dedup"]
    plain = {d: t for d, _, _, t in plain_cut([(k, r["text"]) for k, r in before.items()], 20)}
    assert {r["doc_id"]: r["text"] for r in after} == plain
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == before[r["doc_id"]]["lang"] for r in after)

    before, after = kept["decontamination"]
    clean = sorted(d for d, _, hit, _ in plain_scan([(k, r["text"]) for k, r in before.items()], items) if not hit)
    assert sorted(r["doc_id"] for r in after) == clean and 0 < len(clean) < len(before)

    before, after = kept["best_fit_packing"]
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(packing.vocabulary_path()), []
    for k, r in before.items():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        expected += [(k, i, zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in after) == sorted(expected)
    check_packed(after, 4096)

    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in again) == sorted(expected)
    assert len({r["sequence_id"] for r in again}) == len({r["sequence_id"] for r in after})


#: Names that the operators of the stages use inside or add.
CLASHES = "lang_pred score shares n_words n_removed kept_text doc tkey hit items fp id rest apart__ strip rows component least root __a __b w h p mark near piece length crc pid seq gap slot".split()


def odd_documents(spark, ids):
    passage = " ".join(f"word{k}" for k in range(40))
    texts = [None, "", "  ", "12 34", "The same short text of a few words.", "The same short text of a few words.", "Another text of the house and the garden.", passage + " and so on", "before " + passage + " behind", "x " * 3000 + "the end of it"]
    rows = [(ids[k % len(ids)], t, "en", k, *(f"{c}{k}" for c in CLASHES)) for k, t in enumerate(texts)]
    kind = "string" if any(isinstance(i, str) for i in ids) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


@pytest.mark.parametrize("ids", [[1, 2, 3, None], [None], ["b", "a", None, "c"], list(range(100))])
def test_stages_keep_odd_rows(spark, sf_dir, tmp_path, ids):
    """Null, repeated and textual ids, columns of every inner name: no stage fails, and none drops a document without a reason."""
    docs = odd_documents(spark, ids)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} and docs.count() >= before.count()
            continue
        assert docs.columns == before.columns
        rows = {r["w"]: r for r in docs.collect()}
        if name == "language_id":
            assert set(rows) == {f"w{k}" for k in range(4, 10)}
        if name == "simhash_near_dedup":
            assert len(rows) == 5 and {"w6", "w7", "w8", "w9"} < set(rows)
        if name == "substring_dedup":
            assert len(rows) == 5 and rows["w6"]["text"] == "Another text of the house and the garden." and sum("word20" in r["text"] for r in rows.values()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        assert all(r[c] == f"{c}{w[1:]}" for w, r in rows.items() for c in CLASHES)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0

"""Both layouts of question records give the same evidence, and gold never changes it."""

import json

import pytest

from lodestrand.sources.records import evidence_units, gold_units, normalize_records, read_records

PAIRS = {"_id": "q1", "question": "Who?", "context": [{"title": "Alice", "sentences": ["Alice is  here.", "  ", "She left."]}, {"title": "Bob", "sentences": ["Bob."]}], "answer": "Alice", "supporting_facts": [{"title": "Alice", "sent_idx": 2}, {"title": "Bob", "sent_idx": 9}, {"title": "Alice", "sent_idx": 2}]}
LISTS = {"id": "q1", "question": "Who?", "context": {"title": ["Alice", "Bob"], "sentences": [["Alice is  here.", "  ", "She left."], ["Bob."]]}, "answer": "Alice", "supporting_facts": {"title": ["Alice", "Bob", "Alice"], "sent_id": [2, 9, 2]}}


def test_layouts_agree(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([PAIRS]))
    (tmp_path / "b.jsonl").write_text(json.dumps(LISTS) + "\n")
    a, b = (normalize_records(read_records(spark, str(tmp_path / n))) for n in ("a.json", "b.jsonl"))
    assert a.collect() == b.collect()
    units = {r["unit"] for r in evidence_units(a).collect()}
    assert units == {"SENT::Alice::0::Alice is here.", "SENT::Alice::2::She left.", "SENT::Bob::0::Bob."}
    assert [r["units"] for r in gold_units(b, evidence_units(b)).collect()] == [["SENT::Alice::2::She left."]]
    bare = normalize_records(read_records(spark, str(tmp_path / "a.json")).drop("answer", "supporting_facts"))
    assert {r["unit"] for r in evidence_units(bare).collect()} == units


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader"):
        read_records(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError, match="records need"):
        normalize_records(spark.createDataFrame([(1,)], "id int"))

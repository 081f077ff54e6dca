"""The entity model inside the evaluation: hits beside the rules', failures in both fail modes, each text read once."""

import json
import sys

import pytest
from pyspark import cloudpickle

from veilframe.operators import entities as E
from veilframe.operators import ner as N
from veilframe.operators import sanitize as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model is built where the tasks run
SCHEMA = "request_id string, payload string, effective_profile string, mode string, path_class string"


def requests(spark, *rows):
    return spark.createDataFrame([(str(k), json.dumps(p), profile, mode, path) for k, (p, profile, mode, path) in enumerate(rows)], SCHEMA)


def names():
    """Finds Anna and Acme, and fails where a text asks for it."""
    import re

    def read(texts):
        if any("FAIL" in t for t in texts):
            raise RuntimeError("model")
        return [[("person" if m[0].startswith("Anna") else "organization", m.start(), m.end(), 0.6 if "maybe" in t else 0.9, "en")
                 for m in re.finditer("Anna|Acme", t)] for t in texts]

    return read


def test_model_hits_meet_rule_hits(spark):
    df = requests(spark, ({"a": "Anna wrote to bob@example.com", "b": ["Anna-Maria at Acme", "maybe Anna"]}, "strict", "enforce", "direct"),
                  ({"a": "Anna wrote"}, "minimal", "enforce", "direct"), ({"n": 7}, "strict", "enforce", "direct"))
    got = {r.request_id: r for r in E.evaluate_with_entities(df, names, trace=True).collect()}
    assert json.loads(got["0"].sanitized_payload) == {"a": "[REDACTED] wrote to [REDACTED]", "b": ["[REDACTED] at Acme", "maybe Anna"]}
    assert sorted((h.rule_id, h.ptr, h.st, h.en, h.action) for h in got["0"].hits if h.rule_id.startswith("ner.")) == [
        ("ner.organization.en", "/b/0", 14, 18, "mask"), ("ner.person.en", "/a", 0, 4, "redact"), ("ner.person.en", "/b/0", 0, 10, "redact")]
    assert got["0"].decision.rule_hits_total == 4 and not got["0"].degraded.is_degraded
    assert json.loads(got["1"].sanitized_payload) == {"a": "Anna wrote"} and json.loads(got["2"].sanitized_payload) == {"n": 7}
    assert "entity_hits" not in got["0"].asDict()


@pytest.mark.parametrize("closed", [False, True])
def test_failed_batch(spark, closed, monkeypatch):
    monkeypatch.setattr(N, "BATCH", 1)  # a text fails alone
    settings = E.EntitySettings({"strict": E.EntityProfile(fail_closed=closed)})
    df = requests(spark, ({"a": "FAIL with bob@example.com", "b": "Anna"}, "strict", "enforce", "direct"),
                  ({"a": "FAIL with bob@example.com"}, "strict", "dry_run", "direct"), ({"a": "Anna"}, "strict", "enforce", "direct"))
    got = {r.request_id: r for r in E.evaluate_with_entities(df, names, settings).collect()}
    assert (got["0"].final_action, got["0"].blocked) == (("block", True) if closed else ("redact", False))
    assert got["0"].degraded.is_degraded and got["0"].degraded.fail_closed_applied == closed
    assert ("winner:fail_closed.ner_inference" in got["0"].decision.reason_codes) == closed
    if not closed:  # a failed request has no entity hits, as its texts are one run
        assert json.loads(got["0"].sanitized_payload) == {"a": "FAIL with [REDACTED]", "b": "Anna"}
    assert got["1"].final_action == "redact" and got["1"].degraded.is_degraded and not got["1"].degraded.fail_closed_applied
    assert json.loads(got["2"].sanitized_payload) == {"a": "[REDACTED]"} and not got["2"].degraded.is_degraded


def test_whole_batch_fails_together(spark):
    df = requests(spark, ({"a": "FAIL"}, "strict", "enforce", "direct"), ({"a": "Anna"}, "strict", "enforce", "direct")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert [r.degraded.is_degraded for r in E.evaluate_with_entities(df, names).collect()] == [True, True]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_skips_strips_excludes(spark):
    chat = {"messages": [{"role": "System", "content": "Anna"}, {"role": "user", "content": "Anna"}], "tools": [{"d": "Anna"}], "secret": "Anna"}
    settings = E.EntitySettings({"strict": E.EntityProfile(("person",))}, skip_fields=("^secret$",), exclude=("^Anna$",), strip=("Anna-[A-Z]+",),
                                skip_tools_and_system=True)
    df = requests(spark, (chat, "strict", "enforce", "llm"), ({"x": "Annabel, Anna, Anna-X Annas Acme"}, "strict", "enforce", "llm"))
    found = {r.request_id: [(h.ptr, h.st, h.en) for h in r.entity_hits] for r in E.with_entities(df, names, settings).collect()}
    assert found == {"0": [], "1": []}
    kept = E.EntitySettings({"strict": E.EntityProfile(("person",))}, skip_fields=("^secret$",), strip=("Anna-[A-Z]+",), skip_tools_and_system=True)
    found = {r.request_id: sorted((h.ptr, h.st, h.en) for h in r.entity_hits) for r in E.with_entities(df, names, kept).collect()}
    assert found == {"0": [("/messages/1/content", 0, 4)], "1": [("/x", 0, 7), ("/x", 9, 13), ("/x", 22, 27)]}
    with pytest.raises(ValueError, match="unknown entity types"):
        E.EntitySettings({"strict": E.EntityProfile(("place",))})


def test_typed_payloads_repeated_rows_and_one_run_per_text(spark, tmp_path):
    log = str(tmp_path / "texts")

    def load():
        read = names()

        def logged(texts):
            with open(log, "a", encoding="utf-8") as file:
                file.writelines(t + "\n" for t in texts)
            return read(texts)

        return logged

    df = spark.createDataFrame([("r", ("Anna", ["Anna", None, "x y z"]), "strict", "enforce")] * 5,
                               "request_id string, payload struct<a:string,b:array<string>>, effective_profile string, mode string")
    out = E.evaluate_with_entities(df, load).collect()
    assert len(out) == 5 and all(r.sanitized_payload.a == "[REDACTED]" and r.sanitized_payload.b == ["[REDACTED]", None, "x y z"] for r in out)
    assert all(r.decision.rule_hits_total == 2 for r in out)
    assert sorted(open(log, encoding="utf-8").read().split("\n")[:-1]) == ["Anna", "x y z"]


def test_empty_table(spark):
    assert E.evaluate_with_entities(requests(spark).limit(0), names).collect() == []


def test_evaluation_without_model_is_unchanged(spark):
    df = requests(spark, ({"a": "mail bob@example.com"}, "minimal", "enforce", "direct"), ({"a": "mail bob@example.com"}, "strict", "enforce", "direct"))
    a = {r.request_id: (r.sanitized_payload, r.final_action) for r in S.evaluate(df).collect()}
    assert a == {r.request_id: (r.sanitized_payload, r.final_action) for r in E.evaluate_with_entities(df, names).collect()}

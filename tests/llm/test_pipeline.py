import hashlib

import corpus_pipeline as pipeline
from panelforge.llm.quality_rules import RepetitionRules
from tests.llm.test_exact_dedup import BLANK
from tests.llm.test_minhash_dedup import by_hand as near_by_hand
from tests.llm.test_native import mix_by_hand
from tests.llm.test_quality_rules import by_hand as rules_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tests.llm.test_native.WEIGHTS", pipeline.MIX_WEIGHTS)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 6000")
    rows = {r.doc_id: r for r in docs.collect()}
    got = []
    for name, stage in pipeline.STAGES[:-1]:
        kept = pipeline.pin(stage(spark, docs, SF), name)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {r.doc_id for r in docs.collect()} and kept.count() == len(ids)
        got.append(ids)
        docs = kept
    want = [{i for i, r in rows.items() if rules_by_hand(r.text, RepetitionRules())[-1]}]
    groups = {}
    for i in want[-1]:
        text = rows[i].text
        groups.setdefault(text.translate(BLANK), []).append((-len(text), i))
    want.append({min(g)[1] for g in groups.values()})
    near = near_by_hand([(i, rows[i].text) for i in want[-1]], 5, 80)
    want.append({i for i, (_, root) in near.items() if i == root})
    mixed = mix_by_hand_of([(i, rows[i].text, rows[i].lang, rows[i].source) for i in want[-1]])
    want.append(mixed)
    assert got == want
    out = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(out) == want[-1]
    for i, r in out.items():
        assert r.decoded_sha256 == hashlib.sha256(rows[i].text.encode()).hexdigest()


def mix_by_hand_of(rows):
    return {doc_id for doc_id, _, _ in mix_by_hand(rows, pipeline.MIX_SHARE, 1, seed="mix")}


def test_odd_tables(spark, docs_of):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (1, good), (2, good.replace(" ", "\n")), (3, None), (4, ""), (5, good + " more"), (None, good), (6, good[::-1])]
    docs = docs_of(rows).selectExpr("*", "1 AS TEXT_SHA256", "2 AS kept", "3 AS id", "4 AS component_id")
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.pin(stage(spark, docs, SF), name)
    # of equal texts the most characters stay, then the smallest doc_id (null last)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 6]
    empty = docs_of([])
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_run_gives_tokens(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_rows_without_or_with_repeated_ids_have_their_own_fate(spark, docs_of):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    cases = [
        ([(1, one), (None, one)], [(1, one)]),
        ([(None, one), (None, one + "  ")], [(None, one + "  ")]),
        ([(5, one), (5, two), (7, two + " more"), (None, three), (None, three + " x"), (5, one)], [(5, one), (5, two), (None, None)]),
    ]
    for rows, want in cases:
        docs = docs_of(rows).repartition(3)
        for stage in (pipeline.exact_stage, pipeline.near_stage):
            docs = pipeline.pin(stage(spark, docs, SF), "odd")
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        assert [i for i, _ in got] == [i for i, _ in sorted(want, key=repr)]
        assert all(t in (None, text) for (_, text), (_, t) in zip(got, sorted(want, key=repr), strict=True))

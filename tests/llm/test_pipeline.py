"""Each stage of the pipeline on its own input, and the whole of it through the entry point."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute

import corpus_pipeline
from recitary.llm import op02_packing

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}{k}" for w, k in zip(rng.choice(WORDS, n), rng.integers(0, 40, n), strict=True))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(5000, 30)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        rows.append((i, prose(i, 70) + (" vile scum vermin" if toxic else ""), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(300, prose(1, 70), "en", "s", 1), (301, prose(1, 70) + " x", "en", "s", 1), (302, f"{prose(7, 20)} {item} {prose(8, 60)}", "en", "s", 1), (303, item, "en", "s", 1)]
    rows += [(304, prose(9, 40) + " password = hunter2222 " + prose(10, 20), "en", "s", 1), (305, None, None, None, None), (306, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir, tmp_path):
    docs, item = spark.read.parquet(f"{sf_dir}/documents.parquet"), prose(5000, 30)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs.collect()
    before, rows = seen["toxicity"]
    assert {r.doc_id for r in rows} == {d for d, t in before.items() if "vile" not in (t or "")}
    before, rows = seen["near_duplicates"]
    ids = list(before)
    assert {r.doc_id for r in rows} == {d for d, v in brute.near_duplicates(ids, [before[d] for d in ids], 5).items() if v[2]}
    before, rows = seen["decontamination"]
    after = {r.doc_id: r.text for r in rows}
    assert set(before) - set(after) == {303} and {d for d in after if after[d] != before[d]} == {302}
    assert not any(brute.decontaminate(t, [(1, item)])[4] for t in after.values())
    before, rows = seen["secrets"]
    after = {r.doc_id: r.text for r in rows}
    assert {d for d in before if after[d] != before[d]} == {304} and "hunter" not in after[304]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    before, rows = seen["packing"]
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    tokens = op02_packing.tokenizer(op02_packing.vocabulary_path())
    assert whole == {d: len(next(iter(tokens.encode([t])))) // 4 + 1 for d, t in before.items()}


def test_run(spark, sf_dir):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    fill = out.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert fill.max() <= op02_packing.CAPACITY and len(fill) == -(-fill.sum() // op02_packing.CAPACITY)


def test_token_ids_are_left(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert sum(len(r.ids) for r in op02_packing.sequences(out).collect()) == 4 * sum(r.length for r in rows)


def edge_rows():
    long = prose(77, 60) + " filler" * 120_000 + " " + prose(5000, 30) + " end"
    rows = [(900, None), (901, ""), (902, "  \n\t "), (903, prose(60, 80)), (903, prose(60, 80)), (904, prose(60, 80)), (905, prose(61, 80)), (905, prose(62, 80)), (None, prose(60, 80)), (None, None)]
    return [*rows, (906, long), (907, prose(63, 50) + " vile scum vermin"), (907, prose(63, 50) + " vile scum vermin"), (908, prose(64, 50) + " password = hunter2222 x")]


CLASH = dict.fromkeys("score threshold rejected hit runs n key bands kept component_id redacted spans piece start length offset ids sequence_id node text2 __y y place".split(), 7)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_edge_cases_of_stages(spark, sf_dir, stage):
    from pyspark.sql import functions as F

    run = dict(corpus_pipeline.STAGES)[stage]
    own = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in edge_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    learned = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = (own.unionByName(learned) if stage == "toxicity" else own).withColumns({k: F.lit(v) for k, v in CLASH.items()})
    out = run(spark, docs, sf_dir)
    empty = run(spark, docs.where("false"), sf_dir)
    assert empty.count() == 0 and empty.columns == out.columns
    rows = [r for r in out.collect() if r.doc_id is None or r.doc_id >= 900]
    if stage != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
        held = sorted((str(r.doc_id), str(r.text)) for r in rows)
    before = edge_rows()
    if stage == "toxicity":
        assert held == sorted((str(i), str(t)) for i, t in before if i != 907)
    elif stage == "near_duplicates":
        # 904 is a copy of 903; a null id is no copy, and rows of a kept id stay
        assert held == sorted((str(i), str(t)) for i, t in before if i != 904)
    elif stage == "decontamination":
        assert len(rows) == len(before) and [r for r in rows if r.doc_id == 906][0].text.endswith("end") and prose(5000, 30) not in [r for r in rows if r.doc_id == 906][0].text
        assert [x for x in held if x[0] != "906"] == sorted((str(i), str(t)) for i, t in before if i != 906)
    elif stage == "secrets":
        assert [x for x in held if x[0] != "908"] == sorted((str(i), str(t)) for i, t in before if i != 908) and not any("hunter" in t for _, t in held)
    else:
        ends = {}
        for r in rows:
            ends.setdefault((r.doc_id, r.piece), []).append((r.start, r.length))
        assert ends[900, 0] == [(0, 1)] and ends[901, 0] == [(0, 1)] and len(ends[903, 0]) == 2 and len(ends[None, 0]) == 2
        assert max(p for i, p in ends if i == 906) > 50 and all(r.length <= 2048 and r.offset + r.length <= 2048 for r in rows)

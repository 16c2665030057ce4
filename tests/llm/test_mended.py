"""Cases of learning data and names that once went wrong."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute

from recitary.llm import op04_html, op06_toxicity, op08_quality_model, op09_quality_rules
from recitary.llm.textstats import statistics


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 300, n))


def test_names_inside_an_article():
    page = "<article><h1>T</h1><div class='lead search-engines'>a</div><p id='alert-levels'>b</p><div class='share-prices'>c</div><div class='share-buttons'>x</div><div class='ad'>y</div><aside>z</aside><ul class='related-posts'><li>v</ul><p class='body comment'>w</p></article>"
    assert op04_html.main_text(page) == "T a b c"
    assert op04_html.main_text("<div class='search-engines'>x</div><p>a</p>") == "a"


def test_one_huge_text_leaves_the_rest_to_learn_from(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(op06_toxicity, "learn", lambda hashed, y, lang: seen.update(n=len(hashed), words=sum(map(len, hashed))) or (None, {}))
    rows = [(i, prose(i, 20), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    first = labels.where(op06_toxicity.learning_rows()).orderBy(F.xxhash64("doc_id")).first().doc_id
    huge = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("word "), 5000)).otherwise(F.col("text")))
    known = labels.where(op06_toxicity.learning_rows()).count()
    op06_toxicity.fit(huge, labels, words=3000)
    assert seen["n"] == known - 1 and seen["words"] == 20 * (known - 1)
    op06_toxicity.fit(docs, labels, words=205)
    assert seen["n"] == 10


def test_all_labelled_documents_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(op06_toxicity, "ONE_DOCS", 100)
    passed = []
    inner = op06_toxicity.learn_in_shards

    def seen(rows, n_docs, n_words, ws):
        passed.append((n_docs, n_words, rows.count()))
        return inner(rows, n_docs, n_words, ws)

    monkeypatch.setattr(op06_toxicity, "learn_in_shards", seen)
    docs = spark.createDataFrame([(i, prose(i, 30) + (" vile scum" if i % 3 == 0 else ""), "en") for i in range(900)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    known = labels.where(op06_toxicity.learning_rows()).count()
    toxic = labels.where(op06_toxicity.learning_rows()).where("toxic = 1").count()
    model, cuts = op06_toxicity.fit(docs, labels)
    assert passed == [(known, 30 * known + 2 * toxic, known)] and known > 500
    again, _ = op06_toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert (model.kept == again.kept).all() and np.allclose(model.e, again.e, atol=1e-3)
    out = op06_toxicity.score(docs.join(labels, "doc_id"), model, cuts).where(op06_toxicity.held_out()).collect()
    assert len(out) > 200 and all((r.score >= 0.7) == (r.toxic == 1) for r in out)


def test_cutoffs_of_counted_scores():
    rng = np.random.default_rng(6)
    s, y, n = np.round(rng.random(300), 2), (rng.random(300) < 0.4).astype(float), rng.integers(1, 5, 300)
    lang = np.array(["en"] * 200 + ["de"] * 100)
    again = [np.repeat(v, n) for v in (s, y, lang)]
    assert op06_toxicity.cutoffs(s, y, lang, n) == op06_toxicity.cutoffs(*again, np.ones(n.sum())) and len(op06_toxicity.cutoffs(s, y, lang, n)) == 3


def test_repeated_rows_and_copies_are_no_trials(spark):
    # 300 labelled documents of which some 200 are learned from certify nothing, however often they occur
    rows = [(i, prose(i, 40).replace(" ", " " if i % 5 else "# "), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(300)] + [(1000 * k + i, int(i % 5 > 0)) for i in range(300) for k in range(1, 8)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rejected = lambda d: op09_quality_rules.judge(d.withColumn("rules", F.lit("x")).withColumn("n", F.lit(1)), labels).where(~F.col("base_failed") & ~F.col("kept")).count()
    times = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    again = docs.select("doc_id", "text", "lang", times).drop("k")
    copies = docs.select("doc_id", "text", "lang", times).select((F.col("k") * 1000 + F.col("doc_id")).alias("doc_id"), "text", "lang")
    assert rejected(docs) == 0 and rejected(again) == 0 and rejected(copies) == 0


def test_quality_model_against_its_rules(spark):
    rows = [(i, ("### " * 20 + prose(i, 20)) if i % 5 == 0 else prose(i, 40)) for i in range(400)] + [(7, prose(9, 200)), (500, None), (501, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(3)).withColumn("s", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    kept = []
    found = op08_quality_model.fit_rules
    try:
        op08_quality_model.fit_rules = lambda *a: kept.append(found(*a)) or kept[-1]
        got = sorted((r.doc_id, r.score) for r in op08_quality_model.score(docs, labels).collect())
        again = sorted((r.doc_id, r.score) for r in op08_quality_model.score(docs.repartition(7, "text"), labels).collect())
    finally:
        op08_quality_model.fit_rules = found
    rules, intercept = kept[0]
    named = op08_quality_model.features()
    plain = docs.select("doc_id", statistics(F.col("text"), shapes=True).alias("t")).select("doc_id", "t.*").select("doc_id", *[c.alias(k) for k, c in named.items()]).collect()
    want = sorted((r.doc_id, brute.rule_score(rules, intercept, r.asDict())) for r in plain)
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want]) and got == again


def test_scores_move_half_the_way(spark):
    texts = [prose(i, 60) + (" vile scum" if i % 4 == 0 else "") for i in range(400)]
    y = np.array([i % 4 == 0 and i % 20 < 12 for i in range(400)], dtype=float)
    model, cuts = op06_toxicity.train(texts, y, ["en"] * 400)
    known = op06_toxicity.Rows(model.kept)
    before = [model.score(op06_toxicity.words_of(t, known)) for t in texts[:40]]
    new = op06_toxicity.moved(model, cuts)
    after = [model.score(op06_toxicity.words_of(t, known)) for t in texts[:40]]
    assert cuts[None] < new[None] < op06_toxicity.THRESHOLD and np.argsort(before).tolist() == np.argsort(after).tolist()
    assert [b >= cuts[None] - 1e-9 for b in before] == [a >= new[None] - 1e-9 for a in after]
    shift = model.shift
    assert op06_toxicity.moved(model, {None: 0.9}) == {None: pytest.approx(0.9)} and op06_toxicity.moved(model, {}) == {} and model.shift == shift

from __future__ import annotations

from recitary.functions.alphabet import vocabulary
from recitary.plans.evaluate import evaluate


def test_evaluation(spark):
    ids = {t: i for i, t, _ in vocabulary()}
    said = [("maa", 20), ("<space>", 2), ("ka", 5), ("ta", 5), ("ba", 5)]
    frames, t = [], 0
    for token, n in said:
        for _ in range(n):
            frames.append(("u", t, ids[token]))
            t += 1
        frames.append(("u", t, 0))
        t += 1
    f = spark.createDataFrame(frames, "utt string, t int, id int")
    v = spark.createDataFrame([("u", "مَا كَتَبَ"), ("silent", "مَا")], "utt string, text string")
    out = {r.utt: r for r in evaluate(f, v).collect()}
    u = out["u"]
    assert u.expected == u.predicted == [s for s, _ in said] and u.errors == [] and u.word_errors == []
    # long vowels count as short ones in the average, as recorded: 20 / 8.75
    assert [(m.phoneme_index, m.type, m.observed, m.status) for m in u.madd_results] == [(0, "tabeei", 2.29, "Correct")] and u.madd_errors == []
    assert out["silent"].predicted == [] and out["silent"].madd_results == [] and [e.type for e in out["silent"].errors] == ["Deletion"]

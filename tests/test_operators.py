from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recitary.functions import phonemes as P
from recitary.operators import align, hmm, metrics, rules, sequence, signal, split
from recitary.sources import audio, manifest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def frames(spark, *streams):
    return spark.createDataFrame([(f"u{k}", t, i) for k, s in enumerate(streams) for t, i in enumerate(s)], "utt string, t int, id int")


def test_collapse_and_segments(spark):
    f = frames(spark, [5, 5, 0, 5, 7, 7], [0, 0])
    assert [r.id for r in sequence.ctc_collapse(f).orderBy("utt", "t").collect()] == [5, 5, 7]
    assert [(r.seg, r.id, r.frames) for r in sequence.run_segments(f).orderBy("utt", "seg").collect()] == [(0, 5, 2), (1, 5, 1), (2, 7, 2)]
    assert one(spark, sequence.ctc_collapse_array(F.array(*[F.lit(i) for i in (5, 5, 0, 5, 7, 7)]))) == [5, 5, 7]
    assert sequence.segments_array(sequence.run_segments(f)).first().segments[1] == (5, 1)


def test_uniform_and_chunks(spark):
    def sizes(n, k):
        rows = spark.range(n).select(sequence.uniform_segment(F.col("id"), F.lit(n), F.lit(k)).alias("p")).collect()
        return [sum(r.p == i for r in rows) for i in range(k)]

    assert sizes(7, 3) == [2, 2, 3] and sizes(2, 3) == [0, 0, 2]
    c = [r.c for r in spark.range(8).select(sequence.ceil_chunk(F.col("id"), F.lit(8)).alias("c")).collect()]
    assert [c.count(i) for i in range(6)] == [2, 2, 2, 2, 0, 0]


def test_adjacent_pairs(spark):
    got = sequence.adjacent_pairs(frames(spark, [1, 1, 1, 2, 2, 2, 2, 3])).orderBy("t").collect()
    assert [(r.id, r.t, r.next) for r in got] == [(1, 0, 1), (2, 3, 4), (2, 5, 6)]


def test_lengths_and_padding(spark):
    assert [one(spark, sequence.encoder_length(F.lit(n))) for n in (399, 400, 720)] == [1, 1, 2]
    assert one(spark, sequence.conv_length(F.lit(160))) == 1
    assert one(spark, sequence.pad_or_truncate(F.array(F.lit(1.0), F.lit(2.0)), 4)) == [1, 2, 0, 0]
    assert one(spark, sequence.padding_mask(F.lit(2), F.lit(3))) == [False, False, True]
    rows = spark.createDataFrame([(0, 1, [1.0], [1]), (0, 0, [1.0, 2.0], [2, 3])], "batch int, ordinal int, signal array<float>, targets array<int>")
    r = sequence.collate(rows).first()
    assert r.signals == [[1.0, 2.0], [1.0, 0.0]] and r.targets == [2, 3, 1] and r.signal_lengths == [2, 1] and r.target_lengths == [2, 1]


def test_harakat(spark):
    seg = F.expr("array(named_struct('id',1,'frames',2L), named_struct('id',9,'frames',6L), named_struct('id',1,'frames',4L))")
    assert one(spark, sequence.short_average(seg, F.array(F.lit(1)))) == 3
    assert [(r.segment_index, r.observed_harakat) for r in one(spark, sequence.observed_harakat(seg, F.array(F.lit(1)), F.array(F.lit(9))))] == [(1, 2.0)]
    assert one(spark, sequence.short_average(seg, F.array(F.lit(5)))) is None


def test_alignment_examples():
    assert align.find_errors(["a", "b"], ["a"]) == [{"type": "Deletion", "expected": "b", "predicted": None, "position": 1}]
    assert [(p["expected"], p["predicted"]) for p in align.find_pairs(["x", "a"], ["a"])] == [("a", "a")]
    assert align.find_errors(["a", "b"], ["a", "c"], align.WORD_LABELS)[0]["type"] == "Wrong Word"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_alignment_properties(a, b):
    d = align.distance_table(a, b)[-1, -1]
    assert d == align.distance_table(b, a)[-1, -1] and d <= max(len(a), len(b))
    assert len(align.find_errors(a, b)) == d


def test_edit_distance_native(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("a", "a b"), ("", "")], "a string, b string")
    x = df.select(align.edit_distance(F.filter(F.split("a", " "), lambda s: s != ""), F.filter(F.split("b", " "), lambda s: s != "")).alias("d"))
    assert [r.d for r in x.collect()] == [1, 1, 0]


def test_rules(spark):
    assert [one(spark, rules.verdict(F.lit(float(o)), F.lit(2))) for o in (2.7, 2.9, 1.1)] == ["Correct", "Too Long", "Too Short"]
    meta = F.expr("array(named_struct('kind','sound','char','ج','char_index',0,'is_long_vowel',true))")
    assert one(spark, rules.madd_rules(F.lit("جَاءَ"), meta))[0].type == "tabeei"
    assert one(spark, rules.madd_rules(F.lit("جَاءَ"), meta, intent=True))[0].type == "muttasil"
    r = F.expr("array(named_struct('phoneme_index',0,'type','tabeei','expected_harakat',2), named_struct('phoneme_index',5,'type','x','expected_harakat',2))")
    seg = F.expr("array(named_struct('id',33,'frames',4L), named_struct('id',33,'frames',4L))")
    assert [(v.observed, v.status) for v in one(spark, rules.judge_madd(r, seg, short=[33]))] == [(1.0, "Too Short")]


def test_duration_rules(spark):
    d = spark.createDataFrame([(1, "aː", 100.0), (1, "n", 30.0), (2, "b", 50.0)], "utt int, token string, ms double")
    p = spark.createDataFrame([(1, "n"), (2, "b")], "utt int, token string")
    got = [(r.utt, r.rule_order, r.rule, r.token) for r in rules.check_durations(d, p).orderBy("utt", "rule_order").collect()]
    assert got == [(1, 2, "madd", "aː"), (1, 3, "ghunnah", "n"), (1, 4, "shadda", "n"), (2, 0, "ok", None)]
    s = spark.createDataFrame([(1, 0, "b", 0), (1, 0, "b", 2), (1, 1, "a", 3), (1, 2, "b", None)], "utt int, pos int, token string, state int")
    assert {(r.token, r.ms) for r in rules.duration_map(s).collect()} == {("b", 0.0), ("a", 10.0)}


def test_split(spark):
    df = spark.createDataFrame([(s, v, 1) for s in range(8) for v in range(10)], "speaker int, surah int, ayah int")
    x = split.group_disjoint_split(df, "speaker", ["surah", "ayah"]).cache()
    split.verify(x, "speaker", ["surah", "ayah"])
    test, train = x.where("part = 'test'"), x.where("part = 'train'")
    assert test.select("speaker").distinct().count() == 2 and train.select("speaker").distinct().count() == 6 and x.count() == 80
    with pytest.raises(ValueError, match="share"):
        split.verify(df.withColumn("part", F.when(F.col("surah") < 5, "test").otherwise("train")), "speaker", ["surah", "ayah"])
    assert [r.label for r in split.label_encode(spark.createDataFrame([("b",), ("a",), ("b",)], "v string"), "v").orderBy("v").collect()] == [0, 1, 1]
    assert [r["rank"] for r in split.ranked_by(spark.range(50), "id").orderBy("id").collect()] == list(range(1, 51))


def test_metrics(spark):
    e = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.5, 4.6, 4.7, 4.8, 4.9])), "epoch int, loss double")
    out = metrics.early_stop(e).orderBy("epoch").collect()
    assert [r.best for r in out] == [True, True, False, False, False, False, False] and [r.stopped for r in out] == [False] * 6 + [True]
    m = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 1.0), (1, 0.0)], "b int, v double")
    assert metrics.mean_of_batch_means(m, "b", "v").first()["mean"] == 0.5
    c = metrics.confusion_matrix(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int"), "t", "p", [0, 1])
    assert {(r.t, r["0"], r["1"]) for r in c.collect()} == {(0, 1, 1), (1, 0, 1)}


def test_filters_and_features():
    t = np.arange(16000) / 16000
    low, mid = np.sin(2 * np.pi * 50 * t), np.sin(2 * np.pi * 1000 * t)
    assert np.abs(signal.band_pass(low)[2000:-2000]).max() < 0.01 and abs(np.abs(signal.band_pass(mid)[2000:-2000]).max() - 1) < 0.01
    assert np.abs(signal.high_pass(np.sin(2 * np.pi * 10 * t))[4000:-4000]).max() < 0.01
    assert np.abs(signal.notch_filter(low)[6000:-6000]).max() < 0.1
    quiet = np.r_[np.zeros(8000), mid, np.zeros(8000)]
    assert 15000 < len(signal.trim_silence(quiet)) < 21000
    f = signal.features(mid)
    assert f.shape == (101, 39) and abs(f.mean(0)).max() < 1e-6
    line = np.arange(30.0)[:, None]
    assert np.allclose(signal.delta(line), 1) and np.allclose(signal.delta(line**2, order=2), 2)
    assert signal.preprocess(mid).shape[1] == 39


def test_signal_columns(spark):
    x = F.array(*[F.lit(float(i)) for i in range(40)])
    assert one(spark, signal.slice_clip(x, F.lit(0.001), F.lit(0.002), rate=16000)) == [float(i) for i in range(16, 32)]
    noisy = one(spark, signal.add_noise(x))
    assert 0 < np.abs(np.array(noisy) - np.arange(40)).mean() < 0.02
    rows = spark.createDataFrame([(0, [[1.0] * 6] * 20), (0, [[1.0] * 6] * 20)], "batch int, frames array<array<double>>")
    a, b = [r.frames for r in signal.mask_batch(rows).collect()]
    assert a == b and len(a) == 20


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1600) / 9)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "001002.wav").write_bytes(signal.encode_wav(x, 8000))
    (tmp_path / "r" / "bad.wav").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert got["001002.wav"].n_samples == 3200 and got["bad.wav"].error
    files = manifest.list_recordings(spark, str(tmp_path), "0*").collect()
    assert [(f.reciter_name, f.file) for f in files] == [("r", "001002.wav")]


def test_manifest(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1|2|first\n\n1|2|second|more\nbad line\n1|3|  \n", encoding="utf-8")
    v = manifest.read_verses(spark, str(tmp_path / "v.txt"))
    assert {(r.surah, r.ayah, r.text) for r in v.collect()} == {("1", "2", "first"), ("1", "2", "second|more")}
    assert {r.text for r in manifest.read_verses(spark, str(tmp_path / "v.txt"), strict=True).collect()} == {"first"}
    rec = spark.createDataFrame([("001002.mp3",), ("009009.mp3",)], "file string")
    assert [(r.file, r.ayah_text) for r in manifest.join_verses(rec, v).collect()] == [("001002.mp3", "second|more")]
    assert one(spark, manifest.pad3(F.lit("1234"))) == "1234" and manifest.without_basmala(rec).count() == 2
    wide = spark.createDataFrame([("t", "a.wav", "0.0")], "ayah_text string, Reader string, Other string")
    assert [(r.reciter_name, r.path) for r in manifest.unpivot_reciters(wide, ["ayah_text"], ["Reader", "Other"]).collect()] == [("Reader", "a.wav")]
    manifest.write_phoneme_lines(spark.createDataFrame([("x", ["a", "b"])], "text string, tokens array<string>"), str(tmp_path / "out"))
    assert [(r.text, r.tokens) for r in manifest.parse_phoneme_lines(spark.read.text(str(tmp_path / "out"))).collect()] == [("x", ["a", "b"])]
    manifest.write_chunks(spark.createDataFrame([(i, f"l{i}") for i in range(8)], "i int, l string"), str(tmp_path / "c"), list("abcdef"), "i", "l")
    assert {(r.assignee, r.value) for r in spark.read.text(str(tmp_path / "c")).collect()} == {("abcd"[i // 2], f"l{i}") for i in range(8)}
    manifest.write_csv(spark.createDataFrame([(1, 2, 'p,"q"', "r", "line\ntwo")], manifest.MANIFEST), str(tmp_path / "m"))
    assert manifest.read_csv(spark, str(tmp_path / "m"), manifest.MANIFEST).first().ayah_text == "line\ntwo"


def test_forced_alignment(spark):
    rng = np.random.default_rng(0)
    train = [(tok, int(t), (rng.normal(c, 0.2, 2)).tolist()) for tok, c in (("a", 0), ("b", 5)) for t in range(30)]
    models = hmm.fit_models(spark.createDataFrame(train, "token string, t int, feat array<double>"))
    seq = spark.createDataFrame([("u", 0, "a"), ("u", 1, "zz"), ("u", 2, "b")], "utt string, pos int, token string")
    chains = hmm.join_models(seq, models)
    assert sorted(r.state for r in chains.collect()) == list(range(6))
    x = spark.createDataFrame([("u", t, rng.normal(0 if t < 8 else 5, 0.2, 2).tolist()) for t in range(20)], "utt string, t int, feat array<double>")
    path = hmm.forced_alignment(x, chains).orderBy("t").toPandas()
    assert (path.state[:8] < 3).all() and (path.state[8:] >= 3).all() and path.state.is_monotonic_increasing


def test_viterbi_is_best_path():
    rng = np.random.default_rng(4)
    b = rng.normal(size=(6, 3))

    def score(p):
        if p[0] != 0 or any(y - x not in (0, 1) for x, y in zip(p, p[1:], strict=False)):
            return -np.inf
        return sum(b[t, s] for t, s in enumerate(p)) + sum(np.log(0.4) if y != x else 0.0 if x == 2 else np.log(0.6) for x, y in zip(p, p[1:], strict=False))

    best = max(np.ndindex(*[3] * 6), key=score)
    assert score(tuple(hmm.viterbi(b))) == pytest.approx(score(best))




@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_walk_keeps_few_rows(monkeypatch, whole):
    monkeypatch.setattr(align, "WHOLE", whole)

    def plain(a, b, prefer, to_start):
        table, i, j, out = align.distance_table(a, b), len(a), len(b), []
        while (i or j) if to_start else (i and j):
            if i and j and a[i - 1] == b[j - 1]:
                step = "match"
            else:
                here = table[i, j] - 1
                step = next(s for s in prefer if {"delete": i and table[i - 1, j] == here, "insert": j and table[i, j - 1] == here, "replace": i and j and table[i - 1, j - 1] == here}[s])
            i, j = i - (step != "insert"), j - (step != "delete")
            out.append((step, i, j))
        return out[::-1]

    rng = np.random.default_rng(8)
    for n in range(160):
        a, b = (list("abcde"[k] for k in rng.integers(0, 2 + n % 4, rng.integers(0, 40))) for _ in range(2))
        for prefer in (align.ERRORS, align.PAIRS):
            for to_start in (True, False):
                assert align.walk(a, b, prefer, to_start) == plain(a, b, prefer, to_start)
    import tracemalloc

    a, b = ([str(k) for k in rng.integers(0, 5, 3000)] for _ in range(2))
    tracemalloc.start()
    align.walk(a, b, align.PAIRS, False)
    assert tracemalloc.get_traced_memory()[1] < 12e6  # the whole table is 72 MB
    tracemalloc.stop()


def test_results_leave_in_small_parts():
    rng = np.random.default_rng(9)
    parts = list(signal.signal_udf(lambda x: x, "array<double>").func(iter([pd.Series(list(rng.normal(size=(1000, 4))))])))
    assert [len(p) for p in parts] == [256, 256, 256, 232] and all(isinstance(x, np.ndarray) for p in parts for x in p)


def test_packed_phoneme_lines(spark, tmp_path):
    df = spark.range(20000).select(F.lit("x").alias("text"), F.array(F.lit("ba"), F.lit("maa")).alias("tokens"))
    manifest.write_phoneme_lines(df, str(tmp_path / "out"), compression="gzip")
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) < 20000
    assert manifest.parse_phoneme_lines(spark.read.text(str(tmp_path / "out"))).distinct().collect() == [("x", ["ba", "maa"])]


def test_documents_are_read_where_they_lie(spark, tmp_path):
    from recitary.plans import catalogue

    rows = [(1, "one two three"), (2, None), (3, " "), (4, "four"), (4, "five six"), (None, "seven"), (None, "eight nine")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES["phonemes_full"](spark, str(tmp_path))
    got = {r.doc_id: r for r in df.collect()}
    assert {k: r.words for k, r in got.items()} == {1: 3, 4: 3, None: 3}
    words = spark.createDataFrame([(["بَابٌ", None, "نُور", "بَابٌ"],), (None,), ([],)], "ws array<string>")
    sounds = [r.s for r in words.select(P.phonemes_of_words(F.col("ws")).alias("s")).collect()]
    assert sounds[0][0] == sounds[0][3] == " ".join(P.phonemise("بَابٌ")[0]) and sounds[0][1] == "" and sounds[1:] == [None, []]

"""Queries over Arabic words and over whole evaluations.

The tables hold no Arabic script: each word of the documents stands for one of the words with stated tokens, and
events stand for what a frame model said."""

from __future__ import annotations

from pyspark.sql import functions as F

from recitary.functions import phonemes as P
from recitary.functions import text as T
from recitary.operators import metrics, rules
from recitary.plans.evaluate import evaluate
from recitary.plans.registry import GOLDEN, frames, query, rows, said, spoken, spoken_sql, table, values

_D = "[\\x{064B}-\\x{0652}\\x{0670}]"
_STATED = [w for w, _ in GOLDEN]
_SAID_WORDS = f"WITH {spoken_sql(_STATED)}"
_PLACES = _SAID_WORDS + ", c AS (SELECT word, times, docs, unnest(range(0, length(word))) AS i FROM said)\n"


def _words(spark, sf_dir):
    return said(spark, sf_dir, _STATED)


def _places(spark, sf_dir):
    return _words(spark, sf_dir).select("word", "times", "docs", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))


@query(
    _SAID_WORDS
    + f""", w AS (SELECT *, '  ab' || chr(9) || word || 'ۖ ـ 1 ' || word || chr(10) AS raw FROM said),
k AS (SELECT word, times, docs, regexp_replace(raw, '[ۖۗۘۙۚۛۜ۝۞۩ـ]', '', 'g') AS x FROM w)
SELECT word, times, docs, regexp_replace(trim(regexp_replace(regexp_replace(x, '[^\\x{{0600}}-\\x{{06FF}}\\s]', '', 'g'), '\\s+', ' ', 'g')), 'ل({_D}*)ل{_D}*ه', 'ل\\1لّٰه', 'g') AS clean,
  translate(trim(word), 'إأآٱىةـ', 'ااااي' || 'ه') AS folded FROM k"""
)
def normalize_words(spark, sf_dir):
    raw = F.concat(F.lit("  ab\t"), "word", F.lit("ۖ ـ 1 "), "word", F.lit("\n"))
    return _words(spark, sf_dir).select("word", "times", "docs", T.normalize_arabic(raw).alias("clean"), T.fold_letters(F.col("word")).alias("folded"))


@query(
    _PLACES
    + f"""SELECT word, times, docs, CAST(i AS INTEGER) AS i, regexp_extract(substr(word, i + 1), '^({_D}*)', 1) AS marks,
  CASE WHEN m LIKE '%َ%' THEN 'a' WHEN m LIKE '%ِ%' THEN 'i' WHEN m LIKE '%ُ%' THEN 'u' END AS vowel,
  CASE WHEN m LIKE '%ً%' THEN 'an' WHEN m LIKE '%ٍ%' THEN 'in' WHEN m LIKE '%ٌ%' THEN 'un' END AS tanween,
  CASE nxt WHEN ' ' THEN 'SPACE' WHEN '' THEN NULL ELSE nxt END AS next_one,
  coalesce(list_aggregate(list_reverse(string_split(before, ''))[1:2], 'string_agg', ' '), '') AS before
FROM (SELECT word, times, docs, i, regexp_extract(substr(word, i + 1), '^({_D}*)', 1) AS m, regexp_extract(substr(word, i + 2), '^{_D}*([^ً-ْٰ])', 1) AS nxt,
  regexp_replace(substr(word, 1, i), '{_D}', '', 'g') AS before FROM c)"""
)
def letters_around(spark, sf_dir):
    w, i = F.col("word"), F.col("i")
    marks = T.marks_at(w, i + 1)
    return _places(spark, sf_dir).select(
        "word", "times", "docs", "i", marks.alias("marks"), T.short_vowel(marks).alias("vowel"), T.tanween(marks).alias("tanween"), T.next_significant(w, i).alias("next_one"),
        F.array_join(T.previous_letters(w, i), " ").alias("before"),
    )


@query(_PLACES + "SELECT word, times, docs, CAST(i + 1 AS INTEGER) AS at FROM c WHERE substr(word, i + 1, 2) IN ('َا', 'ِي', 'ُو')")
def madd_places(spark, sf_dir):
    return _words(spark, sf_dir).select("word", "times", "docs", F.explode(T.madd_positions(F.col("word"))).alias("at"))


@query(
    _SAID_WORDS
    + f""" SELECT word, times, docs, list_aggregate(list_filter(string_split(tokens, ' '), lambda t: t NOT IN ('<wasl>', '<space>')), 'string_agg', ' ') AS tokens
FROM said JOIN (VALUES {values(GOLDEN)}) v(word, tokens) USING (word)"""
)
def phonemes_without_marks(spark, sf_dir):
    return _words(spark, sf_dir).select("word", "times", "docs", T.join_tokens(P.phonemes(F.col("word"), marks=False)["tokens"]).alias("tokens"))


# Spelled letters within a verse, with the tokens stated for them.
_SPELLED = [("ب طه ب", "b <space> tˤaa haa <space> b"), ("ب يس", "b <space> yaa sii n"), ("ب حم ب", "b <space> ħaa mii m <space> b")]


@query(f"WITH {spoken_sql([w for w, _ in _SPELLED])} SELECT word, times, docs, tokens FROM said JOIN (VALUES {values(_SPELLED)}) v(word, tokens) USING (word)")
def spelled_letters(spark, sf_dir):
    return said(spark, sf_dir, [w for w, _ in _SPELLED]).select("word", "times", "docs", T.join_tokens(P.phonemes(F.col("word"))["tokens"]).alias("tokens"))


_ANALYSES = [
    ("وكتب", 1, "0", "0", "wa_sub", "0", "verb", "كتب", "كتب_1"),
    ("وكتب", 2, "0", "0", "0", "0", "unk", "", ""),
    ("والشمس", 2, "0", "0", "0", "0", "unk", "", ""),
    ("والشمس", 1, "Al_det", "0", "wa_conj", "0", "noun", "شمس", "شمس_1"),
    ("الكتاب", 1, "0", "0", "0", "0", "noun", "كتاب", "كتاب_1"),
    ("الكتاب", 2, "0", "0", "ال", "0", "noun", "كتاب", "كتاب_2"),
    ("الكتاب", 3, "0", "0", "ال", "0", "verb", "كتاب", "كتاب_3"),
    ("بسم", 1, "0", "bi_prep", "0", "0", "noun", "اسم", "اسم_1"),
    ("فاستقم", 1, "0", "fa_conj", "0", "0", "verb", "استقم", "استقام_1"),
    ("فاستقم", 2, "0", "0", "0", "0", "noun", "فاستقم", "فاستقم_1"),
]
_COLUMNS = ("word", "rank", "prc0", "prc1", "prc2", "prc3", "pos", "stem", "lex")


_KNOWN = list(dict.fromkeys(a[0] for a in _ANALYSES))


def _lexicon(spark):
    return rows(spark, _ANALYSES, ", ".join(f"{c} {'int' if c == 'rank' else 'string'}" for c in _COLUMNS))


@query(
    f"""WITH {spoken_sql(_KNOWN)}, l AS (SELECT *, CASE WHEN prc2 = 'ال' THEN 5 ELSE 0 END + CASE WHEN prc3 IS NOT NULL AND prc3 <> '0' THEN 2 ELSE 0 END + CASE WHEN pos IN ('noun', 'verb') THEN 2 ELSE 0 END - CASE WHEN pos = 'unk' THEN 5 ELSE 0 END AS score
  FROM (VALUES {values(_ANALYSES)}) v({", ".join(f'"{c}"' for c in _COLUMNS)})),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, "rank") AS place, bool_or(prc2 = 'ال') OVER (PARTITION BY word) AS has_al FROM l)
SELECT word, times, docs, prc0, prc1, prc2, prc3, pos, stem, lex, has_al FROM r JOIN said USING (word) WHERE place = 1"""
)
def best_analyses(spark, sf_dir):
    """The best analysis of each word that the documents say."""
    x = said(spark, sf_dir, _KNOWN)
    return P.best_analysis(_lexicon(spark).join(x.select("word"), "word", "left_semi")).join(x, "word")


# Words that the lexicon analyses, and one that it lacks, with their tokens.
_ANALYSED = [("وَكَتَبَ", "wa ka ta ba"), ("وَالشَّمْسِ", "wa <wasl> ʃ ʃa m si"), ("بِسْمِ", "bi <wasl> s mi"), ("فَاسْتَقِمْ", "fa <wasl> s ta qi m"), ("غَيْرِ", "ɣa y ri")]


@query(f"WITH {spoken_sql([w for w, _ in _ANALYSED])} SELECT doc_id, count(*) AS words, md5(string_agg(tokens, ' | ' ORDER BY pos)) AS tokens_md5 FROM spoken JOIN (VALUES {values(_ANALYSED)}) v(word, tokens) USING (word) GROUP BY doc_id")
def lexicon_phonemes(spark, sf_dir):
    """The words of all documents, read with the lexicon once each."""
    x = spoken(spark, sf_dir, [w for w, _ in _ANALYSED])
    words = P.with_analyses(x.select(F.col("word").alias("said")).distinct(), "said", P.best_analysis(_lexicon(spark)), "said")
    read = words.select(F.col("said").alias("word"), T.join_tokens(P.phonemes(F.col("said"), F.col("analyses"))["tokens"]).alias("t"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"])
    return x.join(read, "word").groupBy("doc_id").agg(F.count("*").alias("words"), F.md5(F.array_join(own, " | ")).alias("tokens_md5"))


# Texts with the long-vowel rules that follow from them: place, kind, length; as recorded, and as evidently meant.
_MADD = [
    ("جَاءَ", "0 tabeei 2", "0 muttasil 5"),
    ("قَالَ", "0 tabeei 2", "0 tabeei 2"),
    ("فِي أَرْضِ", "0 tabeei 2", "0 munfasil 5"),
    ("نُور", "0 tabeei 2", "0 tabeei 2"),
]


@query(f"WITH {spoken_sql([w for w, *_ in _MADD])} SELECT word, times, docs, recorded, meant FROM said JOIN (VALUES {values(_MADD)}) v(word, recorded, meant) USING (word)")
def madd_rules_of_texts(spark, sf_dir):
    show = lambda r: F.array_join(F.transform(r, lambda x: F.concat_ws(" ", x["phoneme_index"], x["type"], x["expected_harakat"])), ",")
    x = said(spark, sf_dir, [w for w, *_ in _MADD]).withColumn("meta", P.phonemes(F.col("word"))["meta"])
    return x.select("word", "times", "docs", show(rules.madd_rules(F.col("word"), F.col("meta"))).alias("recorded"), show(rules.madd_rules(F.col("word"), F.col("meta"), intent=True)).alias("meant"))


# What each event stands for as a token (id, token, letters and marks), and the verse that is expected.
_SAID = (("click", 99, "ka", "كَ"), ("view", 192, "maa", "مَا"), ("purchase", 42, "ta", "تَ"), ("signup", 2, "<space>", " "))
_VERSE = ("مَا كَتَبَ", "maa <space> ka ta ba")


def _table_sql(name: str, x: str, y: str) -> str:
    """CTE of the edit table's rows for the lists x (of all utterances) and y: (user_id, i, r)."""
    return f"""{name} AS (SELECT user_id, 0 AS i, range(0, len({y}) + 1) AS r FROM c
  UNION ALL
  SELECT user_id, i + 1, list_transform(range(0, len(w)), lambda k: list_min(w[1:k + 1]) + k) FROM (
    SELECT d.user_id, i, list_concat([CAST(i + 1 AS BIGINT)], list_transform(range(1, len({y}) + 1), lambda j: least(r[j + 1] + 1, r[j] + CASE WHEN {x}[i + 1] = {y}[j] THEN 0 ELSE 1 END) - j)) AS w
    FROM {name} d JOIN c ON d.user_id = c.user_id, x WHERE i < len({x})))"""


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {values(list(_SAID))}) v(event_type, id, token, letters)),
f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
s AS (SELECT user_id, run, any_value(token) AS token, any_value(letters) AS letters, any_value(id) AS id, count(*) AS frames FROM g JOIN e USING (event_type) GROUP BY user_id, run),
c AS (SELECT user_id, list(token ORDER BY run) AS y, list(frames ORDER BY run) AS frames, string_agg(letters, '' ORDER BY run) AS letters,
  list_filter(string_split(string_agg(letters, '' ORDER BY run), ' '), lambda v: v <> '') AS yw, avg(frames) FILTER (id IN (42, 99, 192)) AS short FROM s GROUP BY user_id),
x AS (SELECT string_split('{_VERSE[1]}', ' ') AS x, string_split('{_VERSE[0]}', ' ') AS xw), {_table_sql("d", "x", "y")}, {_table_sql("dw", "xw", "yw")},
w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(5 AS BIGINT) AS a, CAST(len(y) AS BIGINT) AS b, '' AS step FROM c
  UNION ALL
  SELECT user_id, k + 1, CASE WHEN step = 'insert' THEN i ELSE i - 1 END, CASE WHEN step = 'delete' THEN j ELSE j - 1 END, step FROM (
    SELECT w.user_id, w.k, w.a AS i, w.b AS j, CASE WHEN x[w.a] = y[w.b] THEN 'match' WHEN u.r[w.b] = d.r[w.b + 1] - 1 THEN 'replace' WHEN u.r[w.b + 1] = d.r[w.b + 1] - 1 THEN 'delete' ELSE 'insert' END AS step
    FROM w JOIN c ON w.user_id = c.user_id JOIN d ON d.user_id = w.user_id AND d.i = w.a JOIN d u ON u.user_id = w.user_id AND u.i = w.a - 1, x WHERE w.a > 0 AND w.b > 0)),
v AS (SELECT w.user_id, frames[b + 1] / short AS seen FROM w JOIN c ON w.user_id = c.user_id WHERE step IN ('match', 'replace') AND a = 0)
SELECT c.user_id, '{_VERSE[1]}' AS expected, list_aggregate(y, 'string_agg', ' ') AS predicted, letters AS predicted_text, CAST(d.r[len(d.r)] AS INTEGER) AS n_errors, CAST(dw.r[len(dw.r)] AS INTEGER) AS n_word_errors,
  CASE WHEN seen IS NOT NULL THEN 'tabeei' END AS rule, CAST(round(CAST(CAST(seen AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DOUBLE) AS observed, CASE WHEN abs(seen - 2) <= 0.8 THEN 'Correct' WHEN seen < 2 THEN 'Too Short' WHEN seen IS NOT NULL THEN 'Too Long' END AS status
FROM c JOIN d ON c.user_id = d.user_id JOIN dw ON c.user_id = dw.user_id LEFT JOIN v ON v.user_id = c.user_id WHERE d.i = 5 AND dw.i = 2"""
)
def evaluation(spark, sf_dir):
    """From frames to verdicts: the verse's one long vowel against the segment that the alignment pairs with it."""
    ids = F.create_map(*[F.lit(v) for k, i, *_ in _SAID for v in (k, i)])
    said = frames(spark, sf_dir).select("user_id", "t", F.coalesce(F.try_element_at(ids, F.col("event_type")), F.lit(0)).alias("id"))
    verses = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("text", F.lit(_VERSE[0]))
    x = evaluate(said, verses, "user_id").where(F.size("predicted") > 0)
    x = x.withColumn("v", F.get("madd_results", F.lit(0)))
    return x.select(
        "user_id", T.join_tokens(F.col("expected")).alias("expected"), T.join_tokens(F.col("predicted")).alias("predicted"), "predicted_text",
        F.size("errors").alias("n_errors"), F.size("word_errors").alias("n_word_errors"), F.col("v.type").alias("rule"), F.col("v.observed").alias("observed"), F.col("v.status").alias("status"),
    )


@query(
    """SELECT lang, count(*) AS total, count(*) FILTER (WHERE length(text) >= 300) AS processed, count(*) FILTER (WHERE length(text) < 300 OR text IS NULL) AS errors,
  sum(n_chars / 16000.0) / 3600 AS hours, count(*) FILTER (WHERE length(text) < 300) AS failed FROM documents GROUP BY lang"""
)
def processing_counts(spark, sf_dir):
    x = table(spark, sf_dir, "documents").withColumn("error", F.when(F.length("text") < 300, "short").when(F.col("text").isNull(), "none"))
    x = x.withColumn("rate", F.lit(16000.0))
    return metrics.counters(x, F.col("error"), "lang").join(metrics.total_hours(x, "n_chars", error="error", by=["lang"]), "lang")

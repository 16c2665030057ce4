"""The queries for the driver's tables, and their SQL.

Roles: a user's events in the order of (ts, event_id) are a frame stream, 'error' being
the blank; lineitem's supplier is a speaker and (part, line number) a verse; documents
and conversations are text; embeddings are feature vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recitary.functions import phonemes as P
from recitary.functions import text as T
from recitary.functions.alphabet import decode, encode, out_of_vocabulary
from recitary.operators import align, metrics, rules, sequence, signal, split
from recitary.plans.registry import GOLDEN, ORACLES, QUERIES, SEGMENTS, frames, own_words, query, rows, said, segments, spoken, spoken_sql, stands_for, table, values
from recitary.sources import manifest

def numbered(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t")
    return frames(spark, sf_dir).withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("user_id"))})


@query(
    """
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE event_type <> 'error' AND p IS DISTINCT FROM event_type"""
)
def ctc_collapse(spark, sf_dir):
    return sequence.ctc_collapse(frames(spark, sf_dir), "user_id", "t", "event_type", "error").select("user_id", "event_id", "event_type")


@query(
    """
SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS tokens FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE event_type <> 'error' AND p IS DISTINCT FROM event_type GROUP BY user_id"""
)
def ctc_collapse_array(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: s["event_type"])
    out = frames(spark, sf_dir).groupBy("user_id").agg(ids.alias("ids"))
    return out.select("user_id", F.array_join(sequence.ctc_collapse_array(F.col("ids"), F.lit("error")), " ").alias("tokens")).where("tokens <> ''")


@query(SEGMENTS + "SELECT user_id, seg, event_type, frames FROM s")
def run_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("user_id", "seg", "event_type", "frames")


@query(SEGMENTS + "SELECT user_id, seg, round(frames / avg(frames) OVER (PARTITION BY user_id), 6) AS norm FROM s")
def segment_norm_duration(spark, sf_dir):
    return sequence.normalized_durations(segments(spark, sf_dir), "user_id").select("user_id", "seg", F.round("norm", 6).alias("norm"))


def _utterances(spark, sf_dir):
    """One row for each user: the segments in order."""
    return sequence.segments_array(segments(spark, sf_dir), "user_id", "event_type")


HARAKAT = SEGMENTS + ", h AS (SELECT *, avg(CASE WHEN event_type = 'click' THEN frames END) OVER (PARTITION BY user_id) AS short FROM s)\n"


@query(HARAKAT + "SELECT user_id, seg, round(short, 6) AS short, round(frames / short, 6) AS harakat FROM h WHERE event_type = 'view' AND short IS NOT NULL")
def short_avg_and_harakat(spark, sf_dir):
    own, short = F.col("segments"), F.array(F.lit("click"))
    x = _utterances(spark, sf_dir).select("user_id", sequence.short_average(own, short).alias("short"), F.explode(sequence.observed_harakat(own, short, F.array(F.lit("view")))).alias("h"))
    return x.select("user_id", F.col("h.segment_index").alias("seg"), F.round("short", 6).alias("short"), F.round("h.observed_harakat", 6).alias("harakat"))


@query(
    HARAKAT
    + """, e AS (SELECT *, frames / short AS observed, CASE event_type WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 1 END AS expected FROM h)
SELECT user_id, seg, event_type, expected, round(observed, 2) AS observed,
  CASE WHEN abs(observed - expected) <= 0.8 THEN 'Correct' WHEN observed < expected THEN 'Too Short' ELSE 'Too Long' END AS status
FROM e WHERE expected IS NOT NULL AND short IS NOT NULL"""
)
def madd_verdict(spark, sf_dir):
    length = lambda k: F.when(k == "view", 2).when(k == "purchase", 5).when(k == "signup", 1)
    every = F.transform("segments", lambda x, i: F.struct(i.alias("phoneme_index"), x["id"].alias("type"), length(x["id"]).alias("expected_harakat")))
    judged = rules.judge_madd(F.filter(every, lambda r: r["expected_harakat"].isNotNull()), F.col("segments"), short=["click"])
    x = _utterances(spark, sf_dir).select("user_id", F.explode(judged).alias("v"))
    return x.select("user_id", F.col("v.phoneme_index").alias("seg"), F.col("v.type").alias("event_type"), "v.expected", "v.observed", "v.status")


@query(
    """
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, CAST(CASE WHEN n < 5 THEN 4 ELSE least(t // (n // 5), 4) END AS INTEGER) AS part FROM f"""
)
def uniform_segments(spark, sf_dir):
    return numbered(spark, sf_dir).select("user_id", "event_id", sequence.uniform_segment(F.col("rn"), F.col("n"), F.lit(5)).alias("part"))


PAIRS = """
WITH f AS (SELECT user_id, ts, event_id, event_type, lead(event_type) OVER w AS nx,
             CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS k FROM r)
"""


@query(PAIRS + "SELECT user_id, event_id, event_type FROM a WHERE k % 2 = 0 AND event_type = nx")
def adjacent_pairs(spark, sf_dir):
    return sequence.adjacent_pairs(frames(spark, sf_dir), "user_id", "t", "event_type").select("user_id", "event_id", "event_type")


@query(SEGMENTS + "SELECT user_id, event_type AS token, CAST(arg_max(frames, seg) * 10 AS DOUBLE) AS ms FROM s GROUP BY user_id, event_type")
def duration_ms(spark, sf_dir):
    return _durations(spark, sf_dir).select("user_id", "token", "ms")


def _durations(spark, sf_dir):
    """Milliseconds by token, from the state of each frame: three states a segment, in turn."""
    k = F.explode(F.sequence(F.lit(0), (F.col("frames") - 1).cast("int")))
    states = segments(spark, sf_dir).select("user_id", F.col("seg").alias("pos"), F.col("event_type").alias("token"), k.alias("k"))
    return rules.duration_map(states.withColumn("state", (F.col("pos") * 3 + F.col("k") % 3).cast("int")), "user_id").select("user_id", "token", "ms")


@query(
    SEGMENTS
    + """, d AS (SELECT user_id, event_type AS token, CAST(arg_max(frames, seg) * 10 AS DOUBLE) AS ms FROM s GROUP BY user_id, event_type)
SELECT user_id, token, ms FROM d LEFT JOIN (VALUES ('r', 10), ('l', 10), ('n', 20), ('m', 20)) v(token2, least) ON token = token2 WHERE ms < coalesce(least, 20)"""
)
def min_duration_check(spark, sf_dir):
    return _durations(spark, sf_dir).where(F.col("ms") < rules.least_ms(F.col("token"))).select("user_id", "token", "ms")


_NAMES = {"click": "n", "view": "aː", "purchase": "r", "signup": "m"}


@query(
    SEGMENTS
    + """, n AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'n' WHEN 'view' THEN 'aː' WHEN 'purchase' THEN 'r' WHEN 'signup' THEN 'm' ELSE 'error' END AS tok FROM events),
d AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'n' WHEN 'view' THEN 'aː' WHEN 'purchase' THEN 'r' ELSE 'm' END AS token, CAST(arg_max(frames, seg) * 10 AS DOUBLE) AS ms FROM s GROUP BY user_id, event_type),
p1 AS (SELECT *, lead(tok) OVER w AS nx, CASE WHEN tok = lag(tok) OVER w THEN 0 ELSE 1 END AS c FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS k FROM p2),
pairs AS (SELECT user_id, tok AS token FROM p3 WHERE k % 2 = 0 AND tok = nx AND tok <> 'error'),
e AS (
  SELECT user_id, 1 AS rule_order, 'missing' AS rule, token, ms FROM d WHERE ms < CASE WHEN token IN ('r', 'l') THEN 10 ELSE 20 END
  UNION ALL SELECT user_id, 2, 'madd', token, ms FROM d WHERE token = 'aː' AND ms < 150
  UNION ALL SELECT user_id, 3, 'ghunnah', token, ms FROM d WHERE token IN ('n', 'm') AND ms < 120
  UNION ALL SELECT p.user_id, 4, 'shadda', p.token, 2 * coalesce(ms, 0) FROM pairs p LEFT JOIN d USING (user_id, token) WHERE 2 * coalesce(ms, 0) < 80)
SELECT * FROM e UNION ALL SELECT DISTINCT user_id, 0, 'ok', NULL, NULL FROM d WHERE user_id NOT IN (SELECT user_id FROM e)"""
)
def rule_union(spark, sf_dir):
    name = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), c), F.lit("error"))
    d = _durations(spark, sf_dir).withColumn("token", name(F.col("token")))
    pairs = sequence.adjacent_pairs(frames(spark, sf_dir), "user_id", "t", "event_type").select("user_id", name(F.col("event_type")).alias("token")).where("token <> 'error'")
    return rules.check_durations(d, pairs, "user_id")


SPLIT = """
WITH k1 AS (SELECT l_suppkey, row_number() OVER (ORDER BY md5(CAST(l_suppkey AS VARCHAR)), l_suppkey) <= ceil(0.25 * count(*) OVER ()) AS a FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
k2 AS (SELECT l_partkey, l_linenumber, row_number() OVER (ORDER BY md5(l_partkey || '|' || l_linenumber), l_partkey, l_linenumber) <= ceil(0.2 * count(*) OVER ()) AS b FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)),
s AS (SELECT lineitem.*, CASE WHEN a AND b THEN 'test' WHEN NOT a AND NOT b THEN 'train' ELSE 'dropped' END AS part
      FROM lineitem JOIN k1 USING (l_suppkey) JOIN k2 USING (l_partkey, l_linenumber))
"""


def _split(spark, sf_dir):
    return split.group_disjoint_split(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_partkey", "l_linenumber"])


@query(SPLIT + "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, part FROM s")
def group_disjoint_split(spark, sf_dir):
    return _split(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "part")


@query(SPLIT + "SELECT part, count(*) AS rows, 100.0 * count(*) / sum(count(*)) OVER () AS percent, count(DISTINCT l_suppkey) AS speakers, count(DISTINCT (l_partkey, l_linenumber)) AS verses FROM s GROUP BY part")
def split_stats(spark, sf_dir):
    return split.split_stats(_split(spark, sf_dir), "l_suppkey", ["l_partkey", "l_linenumber"])


@query(
    SPLIT
    + """SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM s WHERE part = 'train' INTERSECT SELECT l_suppkey FROM s WHERE part = 'test')) AS speakers,
(SELECT count(*) FROM (SELECT l_partkey, l_linenumber FROM s WHERE part = 'train' INTERSECT SELECT l_partkey, l_linenumber FROM s WHERE part = 'test')) AS verses"""
)
def split_overlap_check(spark, sf_dir):
    s = _split(spark, sf_dir)
    a = split.overlap(s, "l_suppkey").agg(F.count("*").alias("speakers")).withColumn("k", F.lit(1))
    b = split.overlap(s, "l_partkey", "l_linenumber").agg(F.count("*").alias("verses")).withColumn("k", F.lit(1))
    return a.join(b, "k").select("speakers", "verses")


@query(SPLIT + "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM s WHERE part = 'dropped'")
def split_dropped(spark, sf_dir):
    s = _split(spark, sf_dir)
    return s.where(F.col("part") == "dropped").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM documents"""
)
def random_split(spark, sf_dir):
    return split.random_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label FROM events")
def label_encode(spark, sf_dir):
    return split.label_encode(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").select("event_id", F.col("label").cast("int").alias("label"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER () / 6.0) AS BIGINT) AS INTEGER) AS chunk FROM documents")
def ceil_chunks(spark, sf_dir):
    x = split.ranked_by(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return x.select("doc_id", sequence.ceil_chunk(F.col("rank") - 1, F.col("total")).alias("chunk"))


@query("SELECT DISTINCT l_partkey, l_linenumber FROM lineitem")
def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()


@query("SELECT count(*) AS groups FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)")
def ngroups(spark, sf_dir):
    return metrics.distinct_groups(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber")


@query(
    """WITH v AS (SELECT lpad(CAST(c_custkey % 200 AS VARCHAR), 3, '0') || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS key, arg_max(c_name, c_custkey) AS ayah_text FROM customer GROUP BY 1)
SELECT o_orderkey, key, ayah_text FROM (SELECT o_orderkey, lpad(CAST(o_custkey % 200 AS VARCHAR), 3, '0') || lpad(CAST(o_orderkey % 25 AS VARCHAR), 3, '0') AS key FROM orders) JOIN v USING (key) WHERE ayah_text <> ''"""
)
def manifest_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("surah"), F.col("c_nationkey").alias("ayah"), F.col("c_custkey").alias("line_no"), F.col("c_name").alias("text"))
    file = F.concat(manifest.pad3(F.col("o_custkey") % 200), manifest.pad3(F.col("o_orderkey") % 25), F.lit(".mp3"))
    return manifest.join_verses(table(spark, sf_dir, "orders").select("o_orderkey", file.alias("file")), c).select("o_orderkey", "key", "ayah_text")


@query(
    """WITH l AS (SELECT doc_id, doc_id || '|' || lang || '|' || replace(replace(text, chr(10), ' '), chr(13), ' ') AS v FROM documents),
p AS (SELECT doc_id, split_part(v, '|', 1) AS surah, split_part(v, '|', 2) AS ayah, trim(substr(v, length(split_part(v, '|', 1)) + length(split_part(v, '|', 2)) + 3)) AS text FROM l)
SELECT doc_id, surah, ayah, md5(text) AS text_md5 FROM p WHERE text <> ''"""
)
def pipe_parse(spark, sf_dir):
    flat = F.translate("text", "\n\r", "  ")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "lang", flat).alias("value"))
    return manifest.parse_lines(lines).select("doc_id", "surah", "ayah", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, md5(translate(text, 'éèêàâçôùûîï', 'eeeaacouuii')) AS text_md5 FROM documents")
def char_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.translate("text", "éèêàâçôùûîï", "eeeaacouuii")).alias("text_md5"))


# Sample words with the tokens stated for them.
WORDS = {
    "الَّذِينَ": "<wasl> l la ðii na", "اِضْرِبْ": "<wasl> dˤ ri b", "أُولَاتِ": "ʔu laa ti", "بِسْمِ": "bi <wasl> s mi", "هُزُوًا": "hu zu wan",
    "كَالظُّلَلِ": "ka <wasl> ðˤ ðˤu la li", "إِنَّهُ كَانَ": "ʔi n na huu <space> kaa na", "فِيهِ أَجْرٌ": "fii hi <space> ʔa j run", "يُحْيِي": "yu ħ yi yii",
    "بِاللَّٰهِ": "bi <wasl> l laa hi", "لِلشَّمْسِ": "li <wasl> ʃ ʃa m si", "فَالْتَقَطَهُ": "fa <wasl> l ta qa tˤa hu", "وَاسِعٌ": "waa si ʕun", "الْأُولَىٰ": "<wasl> l ʔuu laa",
}
# Words and their sounds in the frame models' alphabet.
MODEL_WORDS = {"بَابٌ": "b aː b", "الكِتَاب": "a l k i t aː b", "شَدّ": "ʃ a d d", "نُور": "n uː r", "فِيل": "f iː l", "هٰذَا": "h ð aː"}


_STATED = [w for w, _ in GOLDEN]


@query(
    f"""WITH {spoken_sql(_STATED)}, g AS (SELECT * FROM (VALUES {values(GOLDEN)}) v(word, tokens))
SELECT doc_id, count(*) AS words, md5(string_agg(tokens, ' | ' ORDER BY pos)) AS tokens_md5 FROM spoken JOIN g USING (word) GROUP BY doc_id"""
)
def phonemes_full(spark, sf_dir):
    """The words of all documents as stated ones, read where the document lies. Only rows that share an id meet in a shuffle, their words by place."""
    docs = table(spark, sf_dir, "documents")
    shared = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    said_by = docs.select("doc_id", own_words().alias("ws")).where(F.size("ws") > 0)

    def read(x: DataFrame) -> DataFrame:
        return x.select("doc_id", P.phonemes_of_words(F.transform("ws", lambda w: stands_for(w, _STATED))).alias("t"))

    def closed(t):
        return F.md5(F.array_join(t, " | ")).alias("tokens_md5")

    one = read(said_by.join(shared, same, "left_anti")).select("doc_id", F.size("t").cast("long").alias("words"), closed(F.col("t")))
    several = read(said_by.join(shared, same, "left_semi")).select("doc_id", F.posexplode("t").alias("pos", "t")).groupBy("doc_id")
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"])
    return one.unionByName(several.agg(F.count("*").alias("words"), closed(own)))


@query(f"WITH {spoken_sql(list(MODEL_WORDS))} SELECT word, tokens, times, docs FROM said JOIN (VALUES {values(list(MODEL_WORDS.items()))}) v(word, tokens) USING (word)")
def phonemes_basic(spark, sf_dir):
    return said(spark, sf_dir, list(MODEL_WORDS)).select("word", F.array_join(P.model_phonemes(F.col("word")), " ").alias("tokens"), "times", "docs")


@query(
    f"""WITH {spoken_sql(_STATED)}
SELECT word, times, docs, regexp_replace(word, 'ل([\\x{{064B}}-\\x{{0652}}\\x{{0670}}]*)ل[\\x{{064B}}-\\x{{0652}}\\x{{0670}}]*ه', 'ل\\1لّٰه', 'g') AS fixed,
  regexp_replace(word, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}}]', '', 'g') AS bare, translate(word, 'أإؤئء', 'ااااا') AS folded FROM said"""
)
def lafz_regex(spark, sf_dir):
    w = F.col("word")
    return said(spark, sf_dir, _STATED).select("word", "times", "docs", T.normalize_name(w).alias("fixed"), T.remove_marks(w).alias("bare"), T.fold_hamza(w).alias("folded"))


@query(
    """SELECT user_id, string_agg(event_type || '_1 ' || event_type || '_2 ' || event_type || '_3', ' ' ORDER BY ts, event_id) AS states,
  string_agg(event_type, ' ' ORDER BY ts, event_id) AS tokens FROM events GROUP BY user_id"""
)
def state_expand(spark, sf_dir):
    own = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: s["event_type"])
    x = frames(spark, sf_dir).groupBy("user_id").agg(own.alias("own")).withColumn("all", T.states(F.col("own")))
    return x.select("user_id", T.join_tokens(F.col("all")).alias("states"), T.join_tokens(T.states_to_tokens(F.col("all"))).alias("tokens"))


# Places in the token table: specials, then consonants, then each with every short vowel, long vowel and tanween.
_TOKENS = {"click": "ba", "view": "maa", "purchase": "<wasl>", "signup": "T?", "error": "<blank>"}
_IDS = {"click": 39, "view": 192, "purchase": 3, "error": 0}


@query(
    f"""WITH v AS (SELECT * FROM (VALUES {values(list(_IDS.items()))}) x(event_type, id))
SELECT user_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY ts, event_id), '') AS ids, CAST(count(*) - count(id) AS INTEGER) AS oov,
  coalesce(string_agg(CASE event_type {" ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _TOKENS.items() if k in _IDS)} END, ' ' ORDER BY ts, event_id), '') AS tokens
FROM events LEFT JOIN v USING (event_type) GROUP BY user_id"""
)
def vocab_lookup(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for kv in _TOKENS.items() for x in kv])
    own = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: name[s["event_type"]])
    x = frames(spark, sf_dir).groupBy("user_id").agg(own.alias("own")).withColumn("ids", encode(F.col("own")))
    return x.select("user_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), out_of_vocabulary(F.col("own")).alias("oov"), F.array_join(decode(F.col("ids")), " ").alias("tokens"))


def _streams(spark, sf_dir):
    """Each user's whole stream as tokens, beside the one of the user before."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: F.substring(s["event_type"], 1, 1))
    x = frames(spark, sf_dir).groupBy("user_id").agg(own.alias("tokens"))
    before = x.select((F.col("user_id") + 1).alias("user_id"), F.col("tokens").alias("expected"))
    return x.join(before, "user_id")


@query(
    """WITH s AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT a.user_id, CAST(levenshtein(a.v, b.v) AS INTEGER) AS distance FROM s a JOIN s b ON a.user_id = b.user_id + 1"""
)
def token_errors_distance(spark, sf_dir):
    return _streams(spark, sf_dir).select("user_id", align.edit_distance(F.col("expected"), F.col("tokens")).alias("distance"))


@query(
    """WITH s AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT a.user_id, CAST(levenshtein(a.v, b.v) AS INTEGER) AS errors FROM s a JOIN s b ON a.user_id = b.user_id + 1"""
)
def token_error_count(spark, sf_dir):
    return _streams(spark, sf_dir).select("user_id", F.size(align.edit_errors(F.col("expected"), F.col("tokens"))).alias("errors"))


#: Rows of the distance table by recursion, each from the one before: costs first, then the running minimum of insertions.
DISTANCES = """WITH RECURSIVE s AS (SELECT user_id, list(substr(event_type, 1, 1) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
p AS (SELECT a.user_id, b.v AS x, a.v AS y FROM s a JOIN s b ON a.user_id = b.user_id + 1),
d AS (SELECT user_id, CAST(0 AS BIGINT) AS i, range(0, len(y) + 1) AS r FROM p
  UNION ALL
  SELECT user_id, i + 1, list_transform(range(0, len(c)), lambda k: list_min(c[1:k + 1]) + k) FROM (
    SELECT d.user_id, i, list_concat([i + 1], list_transform(range(1, len(y) + 1), lambda j: least(r[j + 1] + 1, r[j] + CASE WHEN x[i + 1] = y[j] THEN 0 ELSE 1 END) - j)) AS c
    FROM d JOIN p ON d.user_id = p.user_id WHERE i < len(x))),
"""


def _walk(order: tuple[str, ...], end: str) -> str:
    """The walk back through the table: after step k the places are a and b."""
    test = {
        "replace": "w.a > 0 AND w.b > 0 AND u.r[w.b] = d.r[w.b + 1] - 1",
        "delete": "w.a > 0 AND u.r[w.b + 1] = d.r[w.b + 1] - 1",
        "insert": "w.b > 0 AND d.r[w.b] = d.r[w.b + 1] - 1",
    }
    cases = " ".join(f"WHEN {test[k]} THEN '{k}'" for k in order)
    return (
        DISTANCES
        + f"""w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(len(x) AS BIGINT) AS a, CAST(len(y) AS BIGINT) AS b, '' AS step FROM p
  UNION ALL
  SELECT user_id, k + 1, CASE WHEN step = 'insert' THEN i ELSE i - 1 END, CASE WHEN step = 'delete' THEN j ELSE j - 1 END, step FROM (
    SELECT w.user_id, w.k, w.a AS i, w.b AS j, CASE WHEN w.a > 0 AND w.b > 0 AND p.x[w.a] = p.y[w.b] THEN 'match' {cases} END AS step
    FROM w JOIN p ON w.user_id = p.user_id JOIN d ON d.user_id = w.user_id AND d.i = w.a LEFT JOIN d u ON u.user_id = w.user_id AND u.i = w.a - 1 WHERE {end}))
"""
    )


@query(
    _walk(("replace", "delete", "insert"), "w.a > 0 AND w.b > 0")
    + """SELECT w.user_id, CAST(row_number() OVER (PARTITION BY w.user_id ORDER BY k DESC) - 1 AS INTEGER) AS pos,
  CASE WHEN step <> 'insert' THEN x[a + 1] END AS expected, CASE WHEN step <> 'delete' THEN y[b + 1] END AS predicted,
  CAST(CASE WHEN step <> 'insert' THEN a END AS INTEGER) AS expected_index, CAST(CASE WHEN step <> 'delete' THEN b END AS INTEGER) AS predicted_index
FROM w JOIN p ON w.user_id = p.user_id WHERE k > 0"""
)
def token_alignment(spark, sf_dir):
    return _streams(spark, sf_dir).select("user_id", F.posexplode(align.aligned_pairs(F.col("expected"), F.col("tokens"))).alias("pos", "p")).select("user_id", "pos", "p.*")


def _errors(labels: tuple[str, str, str]) -> str:
    return _walk(("delete", "insert", "replace"), "w.a > 0 OR w.b > 0") + f"""SELECT w.user_id, CASE step WHEN 'delete' THEN '{labels[0]}' WHEN 'insert' THEN '{labels[1]}' ELSE '{labels[2]}' END AS type,
  CASE WHEN step <> 'insert' THEN x[a + 1] END AS expected, CASE WHEN step <> 'delete' THEN y[b + 1] END AS predicted, CAST(CASE WHEN step = 'insert' THEN b ELSE a END AS INTEGER) AS position
FROM w JOIN p ON w.user_id = p.user_id WHERE k > 0 AND step <> 'match'"""


@query(_errors(("Missing Word", "Extra Word", "Wrong Word")))
def word_error_rows(spark, sf_dir):
    x = _streams(spark, sf_dir)
    return x.select("user_id", F.explode(align.word_errors(F.col("expected"), F.col("tokens"))).alias("e")).select("user_id", "e.*")


@query(_errors(("Deletion", "Insertion", "Substitution")))
def token_error_rows(spark, sf_dir):
    x = _streams(spark, sf_dir)
    return x.select("user_id", F.explode(align.edit_errors(F.col("expected"), F.col("tokens"))).alias("e")).select("user_id", "e.*")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT avg(CASE WHEN quality = toxic THEN 1.0 WHEN quality <> toxic THEN 0.0 END) AS accuracy FROM labels")
def label_accuracy(spark, sf_dir):
    return metrics.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT round(avg(m), 9) AS mean FROM (SELECT doc_id // 16 AS batch, avg(quality) AS m FROM labels GROUP BY 1)")
def mean_of_batch_means(spark, sf_dir):
    x = table(spark, sf_dir, "labels").withColumn("batch", sequence.batch_of(F.col("doc_id"), 16))
    return metrics.mean_of_batch_means(x, "batch", "quality").select(F.round("mean", 9).alias("mean"))


@query(
    """WITH c AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((x - avg(CAST(x AS DOUBLE)) OVER w) / (stddev_pop(CAST(x AS DOUBLE)) OVER w + 1e-8), 4) AS z FROM c WINDOW w AS (PARTITION BY label, dim)"""
)
def cmvn(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return signal.cmvn_long(c, "label", "dim", "x").select("vec_id", "dim", F.round("z", 4).alias("z"))


@query("SELECT event_id, round(value / (max(abs(value)) OVER (PARTITION BY user_id) + 1e-8), 6) AS y FROM events")
def peak_normalize(spark, sf_dir):
    return signal.peak_normalize_long(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("y", 6).alias("y"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sequence.argmax(F.col("embedding")).alias("best"))


@query("SELECT vec_id, array_to_string(list_transform(list_concat(embedding, list_value(0.0, 0.0))[1:66], lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ' ') AS padded FROM embeddings")
def pad_truncate(spark, sf_dir):
    padded = sequence.pad_or_truncate(F.col("embedding").cast("array<double>"), 66)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(padded, lambda x: F.round(x * 1000).cast("long").cast("string")), " ").alias("padded"))


@query("SELECT conv_id // 4 AS batch, count(*) AS items, max(length(text)) AS longest, CAST(sum(least(length(text), 320)) AS BIGINT) AS capped FROM conversations GROUP BY 1")
def batch_pad_lengths(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").withColumn("batch", F.floor(F.col("conv_id") / 4))
    n = F.length("text").cast("long")
    return x.groupBy("batch").agg(F.count("*").alias("items"), F.max(n).alias("longest"), F.sum(F.least(n, F.lit(320))).alias("capped"))


@query(
    """SELECT doc_id, CAST(greatest(floor((n_chars - 400) / 320.0) + 1, 1) AS BIGINT) AS encoder,
CAST(greatest(floor((floor((floor((floor((n_chars + 10 - 11) / 5.0) + 1 + 6 - 7) / 4.0) + 1 + 4 - 5) / 4.0) + 1 + 2 - 3) / 2.0) + 1, 1) AS BIGINT) AS conv FROM documents"""
)
def frame_lengths(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", sequence.encoder_length(n).alias("encoder"), sequence.conv_length(n).alias("conv"))


@query(
    """SELECT event_id, round(d, 6) AS delta FROM (SELECT event_id, (1 * (lead(value, 1) OVER w - lag(value, 1) OVER w) + 2 * (lead(value, 2) OVER w - lag(value, 2) OVER w)
 + 3 * (lead(value, 3) OVER w - lag(value, 3) OVER w) + 4 * (lead(value, 4) OVER w - lag(value, 4) OVER w)) / 60.0 AS d
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE d IS NOT NULL"""
)
def delta_interior(spark, sf_dir):
    return signal.delta_long(frames(spark, sf_dir), "user_id", "t", "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 5) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim")
def time_mean_pool(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return metrics.mean_pool(x, "embedding", "label").select("label", "dim", F.round("mean", 5).alias("mean"))


@query("SELECT conv_id, CAST(sum(len(string_split_regex(trim(text), '\\s+')) * 400) AS BIGINT) AS ms FROM conversations GROUP BY conv_id")
def clip_durations(spark, sf_dir):
    words = T.words(F.col("text"))
    items = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i * 0.4).alias("start"), ((i + 1) * 0.4).alias("end")))
    x = table(spark, sf_dir, "conversations").select("conv_id", F.array(F.struct(items.alias("words"))).alias("segments"))
    return manifest.asr_words(x, index=None).groupBy("conv_id").agg(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")).alias("ms"))


@query("SELECT sum(n_chars / 16000.0) / 3600 AS hours, 0 AS failed FROM documents")
def total_hours(spark, sf_dir):
    return metrics.total_hours(table(spark, sf_dir, "documents").select("n_chars", F.lit(16000.0).alias("rate")), "n_chars")


@query(
    """WITH e AS (SELECT l_linenumber AS epoch, avg(l_discount) AS loss FROM lineitem GROUP BY 1),
b AS (SELECT *, coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM e)
SELECT epoch, best FROM b"""
)
def best_epochs(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.avg("l_discount").alias("loss"))
    return metrics.early_stop(e).select("epoch", "best")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 10")
def enough_frames(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("token"))
    return metrics.enough_frames(x).select("token.user_id", "token.event_type", "n")


@query("SELECT nation, year, v FROM (SELECT n_name AS nation, n_nationkey AS a, n_regionkey AS b FROM nation) UNPIVOT (v FOR year IN (a, b)) WHERE v <> 0")
def unpivot_manifest(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), F.when(F.col("n_nationkey") != 0, F.col("n_nationkey")).alias("a"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("b"))
    return manifest.unpivot_reciters(n, ["nation"], ["a", "b"]).select("nation", F.col("reciter_name").alias("year"), F.col("path").cast("int").alias("v"))


# the rest of the catalogue registers itself
from recitary.plans import files, inference, recitation, signals, waveforms  # noqa: E402, F401

"""Queries that write the tables' rows in the recitations' file formats and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from recitary.functions import phonemes as P
from recitary.functions import text as T
from recitary.operators import models, sequence
from recitary.plans.registry import GOLDEN, query, rows, spoken, spoken_sql, table, values
from recitary.sources import audio, manifest
from recitary.sources.scratch import folder


@query("SELECT CAST(c_custkey AS INTEGER) AS surah, c_nationkey AS ayah, c_mktsegment AS reciter_name, md5('a \"' || c_name || '\", line' || chr(10) || 'two') AS text_md5 FROM customer")
def csv_round_trip(spark, sf_dir):
    path = folder(spark, "csv")
    text = F.concat(F.lit('a "'), "c_name", F.lit('", line\ntwo'))
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("surah"), F.col("c_nationkey").alias("ayah"), F.lit("p.mp3").alias("path_of_audio"), F.col("c_mktsegment").alias("reciter_name"), text.alias("ayah_text"))
    manifest.write_csv(x, path)
    return manifest.read_csv(spark, path, manifest.MANIFEST).select("surah", "ayah", "reciter_name", F.md5("ayah_text").alias("text_md5"))


@query(
    """WITH l AS (SELECT doc_id, doc_id || '|' || lang || '|' || replace(replace(text, chr(10), ' '), chr(13), ' ') AS v FROM documents)
SELECT split_part(v, '|', 1) AS surah, split_part(v, '|', 2) AS ayah, md5(trim(split_part(v, '|', 3))) AS text_md5 FROM l WHERE len(string_split(v, '|')) = 3 AND trim(split_part(v, '|', 3)) <> ''"""
)
def verse_lines_strict(spark, sf_dir):
    path = folder(spark, "lines")
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", F.translate("text", "\n\r", "  "))
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select(line.alias("value")).write.text(path)
    return manifest.read_verses(spark, path, strict=True).select("surah", "ayah", F.md5("text").alias("text_md5"))


_STATED = [w for w, _ in GOLDEN]


@query(
    f"""WITH {spoken_sql(_STATED)}, g AS (SELECT * FROM (VALUES {values(GOLDEN)}) v(word, tokens))
SELECT word, tokens, CAST(len(string_split(tokens, ' ')) AS INTEGER) AS n, count(*) AS lines FROM spoken JOIN g USING (word) GROUP BY ALL"""
)
def phoneme_lines(spark, sf_dir):
    """A line for each word of all documents, written (packed, as words repeat) and read again."""
    path = folder(spark, "phonemes")
    read = P.distinct_phonemes(spoken(spark, sf_dir, _STATED), "word").select(F.col("word").alias("text"), "tokens")
    manifest.write_phoneme_lines(read, path, compression="gzip")
    back = manifest.parse_phoneme_lines(spark.read.text(path))
    return back.groupBy(F.col("text").alias("word"), T.join_tokens(F.col("tokens")).alias("tokens"), F.size("tokens").alias("n")).agg(F.count("*").alias("lines"))


@query(
    f"""SELECT CAST(doc_id % 1000 AS INTEGER) AS surah, doc_id, word, tokens FROM documents JOIN (SELECT row_number() OVER () - 1 AS k, word, tokens FROM (VALUES {values(GOLDEN)}) v(word, tokens)) g ON g.k = doc_id % {len(GOLDEN)}"""
)
def phoneme_manifest(spark, sf_dir):
    """A recording for each document, which says a stated word."""
    path = folder(spark, "manifest")
    word = F.get(F.array(*[F.lit(w) for w in _STATED]), (F.col("doc_id") % len(_STATED)).cast("int"))
    x = table(spark, sf_dir, "documents").select((F.col("doc_id") % 1000).cast("int").alias("surah"), F.lit(1).alias("ayah"), F.concat("doc_id", F.lit(".wav")).alias("path_of_audio"), "source", word.alias("ayah_text"))
    x = x.toDF(*[c.split()[0] for c in manifest.MANIFEST.split(", ")])
    manifest.write_phoneme_manifest(P.distinct_phonemes(x, "ayah_text").drop("meta", "error"), path)
    back = manifest.read_csv(spark, path, manifest.PHONEME_MANIFEST)
    doc = F.regexp_extract(back.columns[2], "^([0-9]+)", 1).cast("long")
    return back.select("surah", doc.alias("doc_id"), F.col("ayah_text").alias("word"), T.join_tokens(T.parse_list(F.col("phonemes"))).alias("tokens"))


@query(
    """SELECT assignee, count(*) AS lines, sum(doc_id) AS ids FROM (SELECT doc_id, ['a', 'b', 'c', 'd', 'e', 'f'][CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER () / 6.0) AS BIGINT) AS INTEGER) + 1] AS assignee FROM documents) GROUP BY 1"""
)
def chunk_files(spark, sf_dir):
    path = folder(spark, "chunks")
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("line"))
    manifest.write_chunks(x, path, list("abcdef"), "doc_id", "line")
    back = spark.read.text(path)
    return back.groupBy("assignee").agg(F.count("*").alias("lines"), F.sum(F.col("value").cast("long")).alias("ids"))


#: Embeddings as clips of 64 samples: folder and file by label and id.
_CLIP = "lpad(CAST(label AS VARCHAR), 3, '0') || lpad(CAST(vec_id % 1000 AS VARCHAR), 3, '0') || '-' || vec_id || '.wav'"


@query(
    f"""SELECT 'r' || label AS reciter_name, {_CLIP} AS file, 64 AS n_samples, false AS failed,
  round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 32767) / 32768)), 4) AS total FROM embeddings
UNION ALL SELECT 'r0', 'broken.wav', 0, true, NULL"""
)
def clip_files(spark, sf_dir):
    path = folder(spark, "clips")
    file = F.concat(manifest.pad3(F.col("label")), manifest.pad3(F.col("vec_id") % 1000), F.lit("-"), F.col("vec_id").cast("string"), F.lit(".wav"))
    clips = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), F.col("label").cast("string"), F.lit("/"), file).alias("name"), audio.wav_bytes(F.col("embedding")).alias("content"))
    broken = rows(spark, [("r0/broken.wav", bytearray(b"no wave"))], "name string, content binary")
    audio.write_files(clips.unionByName(broken), path).write.format("noop").mode("overwrite").save()
    files = manifest.list_recordings(spark, path, "*.wav")
    x = files.join(audio.read_wav(spark, path), "path")
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return x.select("reciter_name", "file", "n_samples", F.col("error").isNotNull().alias("failed"), F.round(total, 4).alias("total"))


@query(
    """WITH f AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS surah, lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS ayah FROM nation)
SELECT surah || ayah || '.mp3' AS file, surah, ayah, intent FROM (SELECT *, true AS intent FROM f WHERE ayah NOT IN ('000', '001') UNION ALL SELECT *, false FROM f)"""
)
def basmala_filter(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.concat(manifest.pad3(F.col("n_nationkey")), manifest.pad3(F.col("n_regionkey")), F.lit(".mp3")).alias("file"))
    both = manifest.without_basmala(f, intent=True).withColumn("intent", F.lit(True)).unionByName(manifest.without_basmala(f).withColumn("intent", F.lit(False)))
    return both.select("file", manifest.surah_of(F.col("file")).alias("surah"), manifest.ayah_of(F.col("file")).alias("ayah"), "intent")


@query(
    """WITH c AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT label, list(v ORDER BY dim) AS w FROM (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS v FROM c GROUP BY ALL) GROUP BY label)
SELECT vec_id, CAST(arg_max(m.label, list_dot_product(CAST(embedding AS DOUBLE[]), w)) AS INTEGER) AS id FROM embeddings, m GROUP BY vec_id"""
)
def stored_weights(spark, sf_dir):
    """A linear model whose rows are the labels' mean vectors, stored as a table and read again."""
    path = folder(spark, "weights")
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("v"))
    w = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("w")).orderBy("label").collect()
    models.save_weights(spark, {"weight": [r.w for r in w], "bias": [0.0] * len(w)}, path)
    one = e.select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("frames"))
    return models.frame_ids(one, "vec_id", "frames", models.linear, models.load_weights(spark, path)).select("vec_id", "id")


@query(
    """SELECT batch, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY vec_id) AS lengths, string_agg(CAST(label AS VARCHAR) || ' ' || CAST(vec_id % 3 AS VARCHAR), ' ' ORDER BY vec_id) AS targets,
  count(*) AS items, max(n) AS longest, round(sum(total), 3) AS total, CAST(count(*) * 2 AS INTEGER) AS n_targets
FROM (SELECT vec_id, label, vec_id // 4 AS batch, least(vec_id % 60 + 1, 40) AS n, list_sum(list_transform(embedding[1:CAST(least(vec_id % 60 + 1, 40) AS INTEGER)], lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings) GROUP BY batch"""
)
def collate_batches(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", sequence.batch_of(F.col("vec_id"), 4).alias("batch"), F.slice("embedding", 1, (F.col("vec_id") % 60 + 1).cast("int")).alias("signal"), F.array(F.col("label"), (F.col("vec_id") % 3).cast("int")).alias("targets"))
    got = sequence.collate(x, order="vec_id", cap=40)
    total = F.aggregate(F.flatten("signals"), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return got.select(
        F.col("batch").cast("long").alias("batch"), F.array_join(F.col("signal_lengths").cast("array<string>"), " ").alias("lengths"), F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"),
        F.size("signals").cast("long").alias("items"), F.size(F.get("signals", F.lit(0))).cast("long").alias("longest"), F.round(total, 3).alias("total"), F.aggregate("target_lengths", F.lit(0), lambda a, n: a + n).alias("n_targets"),
    )


@query(
    f"""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / (list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) + 1e-8), 4) AS total,
  64 AS n_samples, ids, CAST(len(string_split(ids, ' ')) AS INTEGER) AS n_ids FROM embeddings JOIN (VALUES (0, '5 192'), (1, '39 3 39'), (2, '4')) v(k, ids) ON k = vec_id % 3"""
)
def training_rows(spark, sf_dir):
    tokens = F.when(F.col("vec_id") % 3 == 0, "['ʔw', 'maa']").when(F.col("vec_id") % 3 == 1, "['ba', '<wasl>', 'nonsense', 'ba']").otherwise("['ʔ']")
    x = sequence.training_rows(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), tokens.alias("phonemes")))
    total = F.aggregate("signal", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return x.select("vec_id", F.round(total, 4).alias("total"), F.col("signal_length").alias("n_samples"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.col("target_length").alias("n_ids"))


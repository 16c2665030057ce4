"""Queries over vectors as signals: cepstra, deltas, masks, clips, decoding, chains and losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from recitary.operators import hmm, metrics, models, sequence, signal, training
from recitary.plans.registry import frames, query, rows, table, values
from recitary.sources.scratch import folder

_DOUBLES = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def _doubles():
    return F.col("embedding").cast("array<double>")


@query(
    f"""WITH e AS (SELECT vec_id, list_concat(list_concat([0, 0, 0, 0, 0, 0, 0, 0], {_DOUBLES}), [0, 0, 0, 0, 0, 0, 0, 0]) AS x FROM embeddings),
fr AS (SELECT vec_id, f, k, (0.5 - 0.5 * cos(2 * pi() * k / 16)) * x[8 * f + k + 1] AS v FROM e, (SELECT unnest(range(0, 9)) AS f), (SELECT unnest(range(0, 16)) AS k)),
po AS (SELECT vec_id, f, b, pow(sum(v * cos(2 * pi() * b * k / 16)), 2) + pow(sum(v * sin(2 * pi() * b * k / 16)), 2) AS p FROM fr, (SELECT unnest(range(0, 9)) AS b) GROUP BY ALL),
ed AS (SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp((m - 15) * ln(6.4) / 27) END AS hz FROM (SELECT i, i * (15 + ln(8000.0 / 1000) / (ln(6.4) / 27)) / 129 AS m FROM (SELECT unnest(range(0, 130)) AS i))),
tr AS (SELECT a.i, b.b, greatest(0, least((1000.0 * b.b - a.hz) / (m.hz - a.hz), (z.hz - 1000.0 * b.b) / (z.hz - m.hz))) * 2 / (z.hz - a.hz) AS w
  FROM ed a JOIN ed m ON m.i = a.i + 1 JOIN ed z ON z.i = a.i + 2, (SELECT unnest(range(0, 9)) AS b) b),
me AS (SELECT vec_id, f, i, sum(p * w) AS e FROM po JOIN tr USING (b) GROUP BY ALL),
db AS (SELECT vec_id, f, i, greatest(d, max(d) OVER (PARTITION BY vec_id) - 80) AS d FROM (SELECT vec_id, f, i, 10 * log10(greatest(e, 1e-10)) AS d FROM me))
SELECT vec_id, CAST(f AS INTEGER) AS t, CAST(n AS INTEGER) AS dim,
  round(sum(d * cos(pi() * n * (2 * i + 1) / 256) * CASE WHEN n = 0 THEN sqrt(1 / 128.0) ELSE sqrt(2 / 128.0) END), 3) AS c
FROM db, (SELECT unnest(range(0, 3)) AS n) GROUP BY ALL"""
)
def cepstra(spark, sf_dir):
    """16-sample windows every 8 samples over the vectors: the whole chain at a small size."""
    own = signal.signal_udf(lambda x: signal.mfcc(x, n_fft=16, hop=8, n=3), "array<array<double>>")
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(own("embedding")).alias("t", "v"))
    return x.select("vec_id", "t", F.posexplode("v").alias("dim", "c")).select("vec_id", "t", "dim", F.round("c", 3).alias("c"))


@query(
    f"""WITH e AS (SELECT vec_id, {_DOUBLES} AS x FROM embeddings),
m AS (SELECT vec_id, x, t, greatest(4, least(t, 59)) AS c FROM e, (SELECT unnest(range(0, 64)) AS t))
SELECT vec_id, CAST(t AS INTEGER) AS t,
  round((4 * (x[c + 5] - x[c - 3]) + 3 * (x[c + 4] - x[c - 2]) + 2 * (x[c + 3] - x[c - 1]) + (x[c + 2] - x[c])) / 60, 6) AS slope,
  round((28 * (x[c + 5] + x[c - 3]) + 7 * (x[c + 4] + x[c - 2]) - 8 * (x[c + 3] + x[c - 1]) - 17 * (x[c + 2] + x[c]) - 20 * x[c + 1]) / 462, 6) AS curve FROM m"""
)
def deltas(spark, sf_dir):
    """Slope and curvature of each vector as a stream of 64 frames, edges included."""
    both = signal.signal_udf(lambda x: np.stack([signal.delta(x[:, None], order=k)[:, 0] for k in (1, 2)]), "array<array<double>>")
    x = table(spark, sf_dir, "embeddings").select("vec_id", both("embedding").alias("d"))
    x = x.select("vec_id", F.posexplode(F.arrays_zip(F.get("d", F.lit(0)).alias("s"), F.get("d", F.lit(1)).alias("c"))).alias("t", "z"))
    return x.select("vec_id", "t", F.round("z.s", 6).alias("slope"), F.round("z.c", 6).alias("curve"))


@query(
    f"""WITH e AS (SELECT vec_id, list_concat(list_concat([0, 0, 0, 0], {_DOUBLES}), [0, 0, 0, 0]) AS x FROM embeddings),
p AS (SELECT vec_id, f, 10 * log10(greatest(list_sum(list_transform(x[4 * f + 1:4 * f + 8], lambda v: v * v)) / 8, 1e-10)) AS db FROM e, (SELECT unnest(range(0, 17)) AS f)),
l AS (SELECT vec_id, min(f) AS a, max(f) AS b FROM (SELECT *, max(db) OVER (PARTITION BY vec_id) AS top FROM p) WHERE db - top > -3 GROUP BY vec_id)
SELECT vec_id, CAST(least(64, 4 * (b + 1)) - 4 * a AS INTEGER) AS n, round(list_sum(list_transform(embedding[4 * a + 1:least(64, 4 * (b + 1))], lambda v: CAST(v AS DOUBLE))), 5) AS total
FROM l JOIN embeddings USING (vec_id)"""
)
def trimmed(spark, sf_dir):
    own = signal.signal_udf(lambda x: signal.trim_silence(x, top_db=3, size=8, hop=4), "array<double>")
    x = table(spark, sf_dir, "embeddings").select("vec_id", own("embedding").alias("y"))
    return x.select("vec_id", F.size("y").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(
    f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS t, round(list_sum(list_transform(range(1, 9), lambda d: CASE WHEN (i - 1 >= vec_id % 6 AND i - 1 < vec_id % 6 + 2) OR (d - 1 >= vec_id % 4 AND d - 1 < vec_id % 4 + 3) THEN 0 ELSE x[8 * (i - 1) + d] END)), 5) AS total
FROM (SELECT vec_id, {_DOUBLES} AS x FROM embeddings), (SELECT unnest(range(1, 9)) AS i)"""
)
def masked_frames(spark, sf_dir):
    """Vectors as 8 frames of 8 dimensions, two frames and three dimensions set to zero."""
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(_doubles(), i * 8 + 1, F.lit(8)))
    x = table(spark, sf_dir, "embeddings").withColumn("f", own)
    masked = signal.mask_frames(F.col("f"), (F.col("vec_id") % 6).cast("int"), 2, (F.col("vec_id") % 4).cast("int"), 3)
    x = x.select("vec_id", F.posexplode(masked).alias("t", "v"))
    return x.select("vec_id", "t", F.round(F.aggregate("v", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


_DRAW = "floor(((CAST('0x' || substr(md5('0|' || vec_id // 16 || '|{k}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) * {most})"


@query(
    f"""WITH m AS (SELECT vec_id, x, {_DRAW.format(k=0, most=4)} AS tw, {_DRAW.format(k=1000, most=3)} AS dw FROM (SELECT vec_id, {_DOUBLES} AS x FROM embeddings)),
s AS (SELECT *, {_DRAW.format(k=1, most="greatest(8 - tw, 1)")} AS ts, {_DRAW.format(k=1001, most="greatest(8 - dw, 1)")} AS ds FROM m)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(list_sum(list_transform(range(0, 8), lambda d: CASE WHEN (t >= ts AND t < ts + tw) OR (d >= ds AND d < ds + dw) THEN 0 ELSE x[8 * t + d + 1] END)), 5) AS total
FROM s, (SELECT unnest(range(0, 8)) AS t)"""
)
def masked_batches(spark, sf_dir):
    """Random masks over vectors as 8 frames of 8 dimensions, the same ones for all of a batch of sixteen."""
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(_doubles(), i * 8 + 1, F.lit(8)))
    x = table(spark, sf_dir, "embeddings").select("vec_id", sequence.batch_of(F.col("vec_id"), 16).cast("long").alias("batch"), own.alias("frames"))
    x = signal.mask_batch(x, times=1, time_most=3, dims=1, dim_most=2).select("vec_id", F.posexplode("frames").alias("t", "v"))
    return x.select("vec_id", "t", F.round(F.aggregate("v", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(
    f"""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
u AS (SELECT *, (CAST('0x' || substr(md5('0|' || vec_id || '|' || i || '|r'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS r, (CAST('0x' || substr(md5('0|' || vec_id || '|' || i || '|a'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS a,
  (CAST('0x' || substr(md5('3|' || vec_id || '|g'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS g FROM c)
SELECT vec_id, round(sum(0.005 * sqrt(-2 * ln(r)) * cos(2 * pi() * a)), 6) AS noise, round(max(abs(0.005 * sqrt(-2 * ln(r)) * cos(2 * pi() * a))), 6) AS loudest, round(sum(x * (0.8 + 0.4 * g)), 5) AS gained FROM u GROUP BY vec_id"""
)
def noise_and_gain(spark, sf_dir):
    """Each vector's noise, in total and at its loudest, and the total after its gain."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", _doubles().alias("x"))
    x = x.withColumns({"noisy": signal.add_noise(F.col("x"), 0.005, key=F.col("vec_id")), "gained": signal.random_gain(F.col("x"), seed=3, key=F.col("vec_id"))})
    x = x.withColumn("apart", F.zip_with("x", "noisy", lambda a, b: b - a))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return x.select("vec_id", F.round(total("apart"), 6).alias("noise"), F.round(F.array_max(F.transform("apart", F.abs)), 6).alias("loudest"), F.round(total("gained"), 5).alias("gained"))


@query(
    f"""SELECT vec_id, round(list_sum(x[CAST((vec_id % 5) * 2 + 1 AS INTEGER):CAST((vec_id % 5) * 2 + 16 AS INTEGER)]), 5) AS total, list_aggregate(list_transform(range(0, 6), lambda t: CASE WHEN t >= vec_id % 7 THEN '1' ELSE '0' END), 'string_agg', '') AS mask
FROM (SELECT vec_id, {_DOUBLES} AS x FROM embeddings)"""
)
def clips_and_masks(spark, sf_dir):
    """Clips of 8 milliseconds at 2,000 samples a second, and padding masks."""
    start = (F.col("vec_id") % 5) / 1000
    clip = signal.slice_clip(_doubles(), start, start + 0.0081, rate=2000)
    mask = sequence.padding_mask((F.col("vec_id") % 7).cast("int"), F.lit(6))
    x = table(spark, sf_dir, "embeddings").select("vec_id", clip.alias("c"), mask.alias("m"))
    return x.select("vec_id", F.round(F.aggregate("c", F.lit(0.0), lambda a, v: a + v), 5).alias("total"), F.array_join(F.transform("m", lambda b: F.when(b, "1").otherwise("0")), "").alias("mask"))


# the squared responses, as both ways filter, in terms of the tangents of the frequencies' half angles
_BAND = "1 / (1 + pow((pow(tan(pi() * {f} / 16000), 2) - tan(pi() * 300 / 16000) * tan(pi() * 4500 / 16000)) / (tan(pi() * {f} / 16000) * (tan(pi() * 4500 / 16000) - tan(pi() * 300 / 16000))), 8))"
_HIGH = "1 / (1 + pow(tan(pi() * 80 / 16000) / tan(pi() * {f} / 16000), 8))"
_HUM = "pow(cos(2 * pi() * 50 / 16000) - cos(2 * pi() * {f} / 16000), 2)"
_NOTCH = f"{_HUM} / ({_HUM} + pow(tan(2 * pi() * 50 / 16000 / 30 / 2) * sin(2 * pi() * {{f}} / 16000), 2))"


@query(
    f"""SELECT n_nationkey, CAST(hz AS INTEGER) AS hz, round({_BAND.format(f="hz")}, 2) AS band, round({_HIGH.format(f="hz")}, 2) AS high, round({_NOTCH.format(f="hz")}, 2) AS notch
FROM nation, (SELECT unnest([100, 250, 1000, 4000]) AS hz)"""
)
def tones(spark, sf_dir):
    """How loud tones of each nation's phase are after the three filters, against the filters' responses."""
    t = np.arange(16_000) / 16_000

    def levels(x: np.ndarray) -> np.ndarray:
        out = []
        for hz in (100, 250, 1000, 4000):
            tone = np.sin(2 * np.pi * hz * t + x[0])
            # whole periods in the middle
            out += [float(np.sqrt(2 * (f(tone)[4800:11200] ** 2).mean())) for f in (signal.band_pass, signal.high_pass, signal.notch_filter)]
        return np.array(out)

    x = table(spark, sf_dir, "nation").select("n_nationkey", signal.signal_udf(levels, "array<double>")(F.array(F.col("n_nationkey") / 10.0)).alias("y"))
    x = x.select("n_nationkey", "y", F.explode(F.array(*[F.struct(F.lit(hz).alias("hz"), F.lit(3 * k).alias("k")) for k, hz in enumerate((100, 250, 1000, 4000))])).alias("f"))
    y = lambda k: F.round(F.get("y", F.col("f.k") + k), 2)
    return x.select("n_nationkey", "f.hz", y(0).alias("band"), y(1).alias("high"), y(2).alias("notch"))


@query(
    f"""WITH f AS (SELECT label, vec_id, CAST(list_position({_DOUBLES}[1:4], list_max({_DOUBLES}[1:4])) - 1 AS INTEGER) AS id FROM embeddings),
c AS (SELECT *, CASE WHEN id = lag(id) OVER (PARTITION BY label ORDER BY vec_id) THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY vec_id) AS run FROM c),
g AS (SELECT label, run, id, count(*) AS frames, min(vec_id) AS start FROM r WHERE id <> 0 GROUP BY ALL)
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY run) - 1 AS INTEGER) AS seg, id, frames, start FROM g"""
)
def greedy_decode(spark, sf_dir):
    """Vectors as frame scores of four classes: best class, then runs; class 0 is the blank."""
    x = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice(_doubles(), 1, 4).alias("scores"))
    return sequence.greedy_decode(x, "label", "vec_id", "scores", 0)


@query(f"SELECT label AS token, count(*) AS n, round(list_sum(list({_DOUBLES}[1] * 1.0 ORDER BY vec_id)[1:3]), 6) AS first FROM embeddings GROUP BY label")
def frames_by_label(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("token"), F.col("vec_id").alias("t"), _doubles().alias("feat"))
    own = F.aggregate(F.slice("frames", 1, 3), F.lit(0.0), lambda a, f: a + F.get(f, F.lit(0)))
    return metrics.frames_by_token(x).select("token", F.size("frames").cast("long").alias("n"), F.round(own, 6).alias("first"))


# Two tokens' chains of three states: mean and variance of each.
_CHAINS = (("a", 0, 10.0, 90.0), ("a", 1, 30.0, 60.0), ("a", 2, 60.0, 80.0), ("b", 0, 20.0, 70.0), ("b", 1, 90.0, 200.0), ("b", 2, 40.0, 50.0))
_ORDER = ("a", "none", "b", "a")
_STATES = values([(3 * k + s, t, k, m, v) for k, t in enumerate(t for t in _ORDER if t != "none") for c, s, m, v in _CHAINS if c == t])


def _models(spark):
    return rows(spark, [(t, s, [m], [v]) for t, s, m, v in _CHAINS], hmm.MODEL)


def _expected(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.posexplode(F.array(*[F.lit(t) for t in _ORDER])).alias("pos", "token"))


@query(f"SELECT user_id, CAST(state AS INTEGER) AS state, token, CAST(pos AS INTEGER) AS pos, CAST(m AS DOUBLE) AS mean, CAST(v AS DOUBLE) AS cov FROM (SELECT DISTINCT user_id FROM events), (VALUES {_STATES}) x(state, token, pos, m, v)")
def joined_chains(spark, sf_dir):
    x = hmm.join_models(_expected(spark, sf_dir), _models(spark), "user_id")
    return x.select("user_id", "state", "token", "pos", F.get("mean", F.lit(0)).alias("mean"), F.get("cov", F.lit(0)).alias("cov"))


@query(
    f"""WITH RECURSIVE m AS (SELECT * FROM (VALUES {_STATES}) x(state, token, pos, m, v)),
f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events),
b AS (SELECT user_id, t, list(-0.5 * ((x - m) * (x - m) / v + ln(2 * pi())) - ln(sqrt(v)) ORDER BY state) AS b FROM f, m GROUP BY user_id, t),
s AS (SELECT user_id, t, list_transform(range(1, 10), lambda k: CASE WHEN k = 1 THEN b[1] ELSE -1e300 END) AS s, list_transform(range(1, 10), lambda k: false) AS moved FROM b WHERE t = 0
  UNION ALL
  SELECT s.user_id, b.t,
    list_transform(range(1, 10), lambda k: greatest(s.s[k] + CASE WHEN k = 9 THEN 0 ELSE ln(0.6) END, CASE WHEN k = 1 THEN -1e300 ELSE s.s[k - 1] + ln(0.4) END) + b.b[k]),
    list_transform(range(1, 10), lambda k: k > 1 AND s.s[k - 1] + ln(0.4) > s.s[k] + CASE WHEN k = 9 THEN 0 ELSE ln(0.6) END)
  FROM s JOIN b ON s.user_id = b.user_id AND b.t = s.t + 1),
n AS (SELECT user_id, max(t) AS t FROM f GROUP BY user_id),
w AS (SELECT s.user_id, s.t, CAST(list_position(s.s, list_max(s.s)) - 1 AS INTEGER) AS state FROM s JOIN n ON s.user_id = n.user_id AND s.t = n.t
  UNION ALL
  SELECT w.user_id, w.t - 1, CASE WHEN s.moved[w.state + 1] THEN w.state - 1 ELSE w.state END FROM w JOIN s ON s.user_id = w.user_id AND s.t = w.t WHERE w.t > 0)
SELECT user_id, t, state FROM w"""
)
def forced_alignment(spark, sf_dir):
    """Event values as one-dimensional features, through chains of three tokens."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1
    x = frames(spark, sf_dir).select("user_id", t.cast("long").alias("t"), F.array("value").alias("feat"))
    return hmm.forced_alignment(x, hmm.join_models(_expected(spark, sf_dir), _models(spark), "user_id"), "user_id")


def _moments(states: str, name: str) -> str:
    """SQL: counts, means and covariances by token and state of the rows of `states` (token, s, a, b), those of the token where none are."""
    of = "avg(a) AS ma, avg(b) AS mb, var_pop(a) + 0.001 AS caa, covar_pop(a, b) AS cab, var_pop(b) + 0.001 AS cbb"
    own = ", ".join(f"CASE WHEN o.token IS NULL THEN e.{c} ELSE o.{c} END AS {c}" for c in ("ma", "mb", "caa", "cab", "cbb"))
    return f"""{name}o AS (SELECT token, s, {of} FROM {states} GROUP BY ALL), {name}e AS (SELECT token, {of} FROM {states} GROUP BY ALL),
{name} AS (SELECT e.token, k.s, {own} FROM {name}e e CROSS JOIN (SELECT unnest(range(0, 3)) AS s) k LEFT JOIN {name}o o ON o.token = e.token AND o.s = k.s)"""


@query(
    f"""WITH f AS (SELECT CAST(label AS VARCHAR) AS token, vec_id // 50 AS utt, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
  row_number() OVER (PARTITION BY label, vec_id // 50 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label, vec_id // 50) AS n FROM embeddings
  QUALIFY count(*) OVER (PARTITION BY label) >= 10),
s1 AS (SELECT *, least(i * 3 // n, 2) AS s FROM f), {_moments("s1", "m1")},
d AS (SELECT f.*, s, -0.5 * ((cbb * pow(a - ma, 2) - 2 * cab * (a - ma) * (b - mb) + caa * pow(b - mb, 2)) / (caa * cbb - cab * cab) + 2 * ln(2 * pi()) + ln(caa * cbb - cab * cab)) AS l FROM f JOIN m1 USING (token)),
c AS (SELECT token, utt, n, s, i, sum(l) OVER (PARTITION BY token, utt, s ORDER BY i) AS c FROM d),
g AS (SELECT token, utt, n, list(c ORDER BY i) FILTER (s = 0) AS c0, list(c ORDER BY i) FILTER (s = 1) AS c1, list(c ORDER BY i) FILTER (s = 2) AS c2 FROM c GROUP BY ALL),
h AS (SELECT *, unnest(range(1, n + 1)) AS x FROM g), k AS (SELECT *, unnest(CASE WHEN x = n THEN [0] ELSE range(1, n - x + 1) END) AS y FROM h),
v AS (SELECT token, utt, x, y, c0[x] + (x - 1) * ln(0.6) + CASE WHEN x = n THEN 0 ELSE ln(0.4) + c1[x + y] - c1[x] + (y - 1) * ln(0.6) + CASE WHEN x + y = n THEN 0 ELSE ln(0.4) + c2[n] - c2[x + y] END END AS score FROM k),
w AS (SELECT token, utt, arg_max(x, score) AS x, arg_max(y, score) AS y FROM v GROUP BY ALL),
s2 AS (SELECT f.*, CASE WHEN i < x THEN 0 WHEN i < x + y THEN 1 ELSE 2 END AS s FROM f JOIN w USING (token, utt)), {_moments("s2", "m2")}
SELECT token, CAST(s AS INTEGER) AS state, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(caa, 6) AS aa, round(cab, 6) AS ab, round(cbb, 6) AS bb FROM m2"""
)
def fitted_chains(spark, sf_dir):
    """Chains of the labels over all vectors' first two entries, fifty vectors a recording, after two rounds.
    SQL finds the best paths by trying every pair of places where the state changes."""
    x = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 50).alias("utt"), "vec_id", F.slice(_doubles(), 1, 2).alias("feat"))
    m = hmm.fit_models(x, "label", "feat", "vec_id", ["utt"], rounds=2)
    at = lambda c, k: F.round(F.get(c, F.lit(k)), 6)
    return m.select("token", "state", at("mean", 0).alias("mean_a"), at("mean", 1).alias("mean_b"), at("cov", 0).alias("aa"), at("cov", 1).alias("ab"), at("cov", 3).alias("bb"))


@query(
    f"""SELECT vec_id, round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[CAST(label + 1 AS INTEGER)], 6) AS loss FROM (SELECT vec_id, label, {_DOUBLES} AS x FROM embeddings)"""
)
def label_loss(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(models.cross_entropy(_doubles(), F.col("label")), 6).alias("loss"))


@query(
    f"""WITH RECURSIVE e AS (SELECT vec_id, [0, 1 + vec_id % 7, 0, 1 + vec_id % 5, 0] AS g, {_DOUBLES} AS x FROM embeddings),
l AS (SELECT vec_id, g, t, list_transform(range(1, 6), lambda k: x[8 * t + g[k] + 1] - ln(list_sum(list_transform(x[8 * t + 1:8 * t + 8], lambda v: exp(v))))) AS p FROM e, (SELECT unnest(range(0, 8)) AS t)),
a AS (SELECT vec_id, g, t, list_transform(range(1, 6), lambda k: CASE WHEN k <= 2 THEN exp(p[k]) ELSE 0 END) AS a FROM l WHERE t = 0
  UNION ALL
  SELECT a.vec_id, a.g, l.t, list_transform(range(1, 6), lambda k: exp(l.p[k]) * (a.a[k] + CASE WHEN k > 1 THEN a.a[k - 1] ELSE 0 END + CASE WHEN k > 2 AND a.g[k] <> 0 AND a.g[k] <> a.g[k - 2] THEN a.a[k - 2] ELSE 0 END))
  FROM a JOIN l ON a.vec_id = l.vec_id AND l.t = a.t + 1)
SELECT vec_id, round(-ln(a[4] + a[5]), 6) AS loss FROM a WHERE t = 7"""
)
def alignment_loss(spark, sf_dir):
    """Vectors as scores of 8 frames and 8 classes, against two target ids."""
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(_doubles(), i * 8 + 1, F.lit(8)))
    targets = F.array((1 + F.col("vec_id") % 7).cast("int"), (1 + F.col("vec_id") % 5).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(models.ctc_losses(own, targets), 6).alias("loss"))


#: Epochs of the trained head, its first rate and decay, and the length that gradients are cut to.
_EPOCHS, _DECAY, _CLIP, _CLASSES = 6, 0.01, 0.05, 10


def _training_sql(first_rate: float) -> str:
    """CTEs of the head's training, epoch after epoch, over weights as rows (c, k, w, m, v), k = 0 being the bias: w1.. and the epochs as rows of `e`."""
    parts = [
        f"""x AS (SELECT vec_id, label AS y, vec_id % 5 = 0 AS held, unnest(list_concat([1.0], {_DOUBLES})) AS f, generate_subscripts(list_concat([1.0], {_DOUBLES}), 1) - 1 AS k FROM embeddings)""",
        f"w0 AS (SELECT CAST(c AS INTEGER) AS c, CAST(k AS INTEGER) AS k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT unnest(range(0, {_CLASSES})) AS c), (SELECT unnest(range(0, 65)) AS k))",
    ]
    for e in range(1, _EPOCHS + 1):
        scored = lambda name, w: (
            f"{name}z AS MATERIALIZED (SELECT vec_id, y, held, c, sum(f * w) AS z FROM x JOIN {w} USING (k) GROUP BY ALL), "
            f"{name}p AS MATERIALIZED (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM {name}z)"
        )
        parts += [
            scored(f"a{e}", f"w{e - 1}"),
            f"g{e} AS MATERIALIZED (SELECT c, k, avg((p - CASE WHEN c = a{e}p.y THEN 1 ELSE 0 END) * f) AS g FROM a{e}p JOIN x USING (vec_id) WHERE NOT a{e}p.held GROUP BY ALL)",
            f"n{e} AS (SELECT least(1.0, {_CLIP} / (sqrt(sum(g * g)) + 1e-6)) AS cut FROM g{e})",
            f"u{e} AS (SELECT c, k, w, 0.9 * m + 0.1 * g * cut AS m, 0.999 * v + 0.001 * pow(g * cut, 2) AS v FROM w{e - 1} JOIN g{e} USING (c, k), n{e})",
            f"w{e} AS MATERIALIZED (SELECT c, k, w * (1 - rate * {_DECAY}) - rate * (m / (1 - pow(0.9, {e}))) / (sqrt(v / (1 - pow(0.999, {e}))) + 1e-8) AS w, m, v FROM u{e}, r{e - 1}p)",
            scored(f"b{e}", f"w{e}"),
            f"l{e} AS MATERIALIZED (SELECT (SELECT avg(-ln(p)) FROM a{e}p WHERE c = y AND NOT held) AS train_loss, (SELECT avg(-ln(p)) FROM b{e}p WHERE c = y AND held) AS valid_loss, "
            f"(SELECT avg(CASE WHEN y = top THEN 1.0 ELSE 0.0 END) FROM (SELECT vec_id, any_value(y) AS y, arg_max(c, p) AS top FROM b{e}p WHERE held GROUP BY vec_id)) AS accuracy)",
            # the least loss by a share and strictly, epochs without a fall and that were not the best, and whether training has ended before
            f"s{e} AS (SELECT p.*, l{e}.*, valid_loss < low * (1 - 1e-4) AS fell, valid_loss < best AS is_best FROM r{e - 1}p p, l{e})",
            f"r{e} AS MATERIALIZED (SELECT {e} AS epoch, train_loss, valid_loss, accuracy, is_best, over OR worse >= 4 AS over, least(best, valid_loss) AS best, CASE WHEN is_best THEN 0 ELSE worse + 1 END AS worse, "
            f"CASE WHEN fell THEN valid_loss ELSE low END AS low, CASE WHEN fell OR bad = 2 THEN 0 ELSE bad + 1 END AS bad, CASE WHEN NOT fell AND bad = 2 THEN rate / 2 ELSE rate END AS rate FROM s{e})",
            f"r{e}p AS (SELECT low, bad, rate, best, worse, over FROM r{e})",
        ]
    parts.insert(2, f"r0p AS (SELECT 1e300 AS low, 0 AS bad, CAST({first_rate} AS DOUBLE) AS rate, 1e300 AS best, 0 AS worse, false AS over)")
    every = " UNION ALL ".join(f"SELECT * FROM r{e}" for e in range(1, _EPOCHS + 1))
    return f"WITH {', '.join(parts)}, e AS (SELECT * FROM ({every}) WHERE NOT over)"


def _head(spark, sf_dir, path: str, rate: float):
    x = table(spark, sf_dir, "embeddings")
    held = F.col("vec_id") % 5 == 0
    start = {"0.weight": np.zeros((_CLASSES, 64)), "0.bias": np.zeros(_CLASSES)}
    return training.train(x.where(~held), x.where(held), start, path, "embedding", "label", _EPOCHS, optimiser=training.AdamW(rate, _DECAY), clip=_CLIP)


@query(_training_sql(0.8) + " SELECT CAST(epoch AS INTEGER) AS epoch, round(train_loss, 5) AS train_loss, round(valid_loss, 5) AS valid_loss, round(accuracy, 6) AS accuracy, round(rate, 6) AS rate, is_best AS best FROM e")
def trained_head(spark, sf_dir):
    """A softmax head over all vectors, a fifth of them held out, at a rate so high that it is lowered and training ends early."""
    e = _head(spark, sf_dir, folder(spark, "head"), 0.8)
    return e.select("epoch", F.round("train_loss", 5).alias("train_loss"), F.round("valid_loss", 5).alias("valid_loss"), F.round("accuracy", 6).alias("accuracy"), F.round("rate", 6).alias("rate"), "best")


@query(
    _training_sql(0.004)
    + f""", a AS ({" UNION ALL ".join(f"SELECT {e} AS epoch, c, k, w FROM w{e}" for e in range(1, _EPOCHS + 1))})
SELECT CAST(a.epoch AS INTEGER) AS epoch, c, k, round(w, 6) AS w FROM a JOIN (SELECT max(epoch) AS epoch FROM e WHERE is_best) b ON a.epoch = b.epoch"""
)
def best_epoch_weights(spark, sf_dir):
    """The weights that training has left: those of the epoch with the least loss."""
    path = folder(spark, "head")
    _head(spark, sf_dir, path, 0.004)
    epoch = max(training.BestEpoch(spark, path).epochs())
    x = models.weight_rows(spark, f"{path}/epoch-{epoch:05}").where("name IN ('0.weight', '0.bias')")
    x = x.select("name", "shape", F.posexplode("values").alias("i", "w"))
    bias, width = F.col("name") == "0.bias", F.get("shape", F.lit(1))
    c, k = F.when(bias, F.col("i")).otherwise(F.floor(F.col("i") / width)), F.when(bias, 0).otherwise(F.col("i") % width + 1)
    return x.select(F.lit(epoch).cast("int").alias("epoch"), c.cast("int").alias("c"), k.cast("int").alias("k"), F.round("w", 6).alias("w"))

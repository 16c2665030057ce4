"""Queries that run parts of the sequence models over vectors as 8 frames of 8 dimensions; SQL makes the same of sums.
Weights follow from a formula, are stored as a table and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from recitary.operators import models
from recitary.plans.registry import query, table
from recitary.sources.scratch import folder

#: Weights' names with their shapes; a name's number seeds the formula.
_SHAPES = {
    "query.weight": (8, 8), "query.bias": (8,), "key.weight": (8, 8), "key.bias": (8,), "value.weight": (8, 8), "value.bias": (8,), "out.weight": (8, 8), "out.bias": (8,),
    "norm.weight": (8,), "norm.bias": (8,), "up.weight": (16, 8), "up.bias": (16,), "wide.weight": (8, 16), "wide.bias": (8,), "down.weight": (8, 8), "down.bias": (8,),
    "depth.weight": (8, 3), "depth.bias": (8,), "batch.mean": (8,), "batch.var": (8,), "batch.weight": (8,), "batch.bias": (8,),
    "input": (16, 8), "hidden": (16, 4), "bias": (16,), "first.weight": (5, 8), "first.bias": (5,), "second.weight": (3, 5), "second.bias": (3,),
}


def _weight(name: str) -> np.ndarray:
    seed, shape = list(_SHAPES).index(name), _SHAPES[name]
    place = np.add.outer(17.0 * np.arange(shape[0]), 3.0 * np.arange(shape[1])) if len(shape) == 2 else 17.0 * np.arange(shape[0])
    return np.sin(seed + place) / 2 + (1.5 if name == "batch.var" else 0)


def _sql(name: str, i: str, j: str = "0") -> str:
    return f"(sin({list(_SHAPES).index(name)} + 17 * {i} + 3 * {j}) / 2 + {1.5 if name == 'batch.var' else 0})"


def _stored(spark, names: dict[str, str]) -> models.Weights:
    """The weights under other names, written and read."""
    path = folder(spark, "model")
    models.save_weights(spark, {new: _weight(old)[:, None, :] if old == "depth.weight" else _weight(old) for new, old in names.items()}, path)
    return models.load_weights(spark, path)


def _linear(names: str) -> dict[str, str]:
    return {f"{n}.{p}": f"{n}.{p}" for n in names.split() for p in ("weight", "bias")}


def _frames(spark, sf_dir):
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", own.alias("frames"))


def _shown(df):
    x = df.select("vec_id", "t", F.posexplode("y").alias("c", "y"))
    return x.select("vec_id", "t", "c", (F.round("y", 6) + F.lit(0.0)).alias("y"))


_X = "x AS (SELECT vec_id, i // 8 AS t, i % 8 AS c, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
_NORM = f"""m AS (SELECT vec_id, t, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY ALL),
n AS (SELECT x.vec_id, x.t, c, (v - m) / sqrt(s + 1e-5) * {_sql("norm.weight", "c")} + {_sql("norm.bias", "c")} AS v FROM x JOIN m USING (vec_id, t))"""
_OUT = "SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(c AS INTEGER) AS c, round(v, 6) + 0.0 AS y FROM "


def _layer(out: str, source: str, name: str, size: int) -> str:
    """CTE: a linear layer over rows (vec_id, t, c, v)."""
    return f"{out} AS (SELECT vec_id, t, o AS c, sum(v * {_sql(name + '.weight', 'o', 'c')}) + any_value({_sql(name + '.bias', 'o')}) AS v FROM {source}, (SELECT unnest(range(0, {size})) AS o) GROUP BY vec_id, t, o)"


@query(
    f"""WITH {_X}, {_layer("q", "x", "query", 8)}, {_layer("k", "x", "key", 8)}, {_layer("v", "x", "value", 8)},
s AS (SELECT q.vec_id, q.t, k.t AS u, q.c // 4 AS h, exp(sum(q.v * k.v) / 2) AS e FROM q JOIN k ON q.vec_id = k.vec_id AND q.c = k.c GROUP BY ALL),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, t, h) AS p FROM s),
z AS (SELECT p.vec_id, p.t, v.c, sum(p * v.v) AS v FROM p JOIN v ON v.vec_id = p.vec_id AND v.t = p.u AND v.c // 4 = p.h GROUP BY ALL), {_layer("o", "z", "out", 8)}
{_OUT} o"""
)
def attention_outputs(spark, sf_dir):
    """Attention with two heads over the eight frames of each vector."""
    w = _stored(spark, _linear("query key value out"))
    return _shown(models.outputs(_frames(spark, sf_dir), "vec_id", "frames", lambda x, w: models.attention(x, w, 2), w))


@query(f"""WITH {_X}, {_NORM}, {_layer("u", "n", "up", 16)}, a AS (SELECT vec_id, t, c, v / (1 + exp(-v)) AS v FROM u), {_layer("d", "a", "wide", 8)}, o AS (SELECT vec_id, t, c, x.v + d.v / 2 AS v FROM x JOIN d USING (vec_id, t, c)) {_OUT} o""")
def half_step_outputs(spark, sf_dir):
    w = _stored(spark, _linear("norm up") | {"down.weight": "wide.weight", "down.bias": "wide.bias"})
    return _shown(models.outputs(_frames(spark, sf_dir), "vec_id", "frames", models.half_step, w))


@query(
    f"""WITH {_X}, {_NORM}, {_layer("u", "n", "up", 16)},
g AS (SELECT a.vec_id, a.t, a.c, a.v / (1 + exp(-b.v)) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id AND b.t = a.t AND b.c = a.c + 8 WHERE a.c < 8),
e AS (SELECT vec_id, t + 1 - k AS t, c, sum(v * {_sql("depth.weight", "c", "k")}) + any_value({_sql("depth.bias", "c")}) AS v FROM g, (SELECT unnest(range(0, 3)) AS k) WHERE t + 1 - k BETWEEN 0 AND 7 GROUP BY vec_id, t + 1 - k, c),
b AS (SELECT vec_id, t, c, (v - {_sql("batch.mean", "c")}) / sqrt({_sql("batch.var", "c")} + 1e-5) * {_sql("batch.weight", "c")} + {_sql("batch.bias", "c")} AS v FROM e),
a AS (SELECT vec_id, t, c, v / (1 + exp(-v)) AS v FROM b), {_layer("d", "a", "down", 8)}, o AS (SELECT vec_id, t, c, x.v + d.v AS v FROM x JOIN d USING (vec_id, t, c)) {_OUT} o"""
)
def gated_convolution_outputs(spark, sf_dir):
    w = _stored(spark, _linear("norm up down depth") | {f"batch.{p}": f"batch.{p}" for p in ("mean", "var", "weight", "bias")})
    return _shown(models.outputs(_frames(spark, sf_dir), "vec_id", "frames", models.gated_convolution, w))


def _gate(k: str) -> str:
    """One gate of the chain at a step: place k among the sixteen, from the frame's inputs and the state h before."""
    return f"(f.f[t + 2][{k} + 1] + list_sum(list_transform(range(0, 4), lambda j: h[j + 1] * {_sql('hidden', f'({k})', 'j')})))"


@query(
    f"""WITH RECURSIVE {_X},
i AS (SELECT vec_id, t, o, sum(v * {_sql("input", "o", "c")}) + any_value({_sql("bias", "o")}) AS v FROM x, (SELECT unnest(range(0, 16)) AS o) GROUP BY vec_id, t, o),
f AS (SELECT vec_id, list(f ORDER BY t) AS f FROM (SELECT vec_id, t, list(v ORDER BY o) AS f FROM i GROUP BY ALL) GROUP BY vec_id),
r AS (SELECT vec_id, CAST(-1 AS BIGINT) AS t, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS h, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS c FROM f
  UNION ALL
  SELECT vec_id, t, list_transform(range(0, 4), lambda k: 1 / (1 + exp(-o[k + 1])) * tanh(c[k + 1])), c FROM (
    SELECT r.vec_id, r.t + 1 AS t, list_transform(range(0, 4), lambda k: {_gate("12 + k")}) AS o,
      list_transform(range(0, 4), lambda k: 1 / (1 + exp(-{_gate("4 + k")})) * r.c[k + 1] + 1 / (1 + exp(-{_gate("k")})) * tanh({_gate("8 + k")})) AS c
    FROM r JOIN f ON r.vec_id = f.vec_id WHERE r.t < 7))
SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS c, round(unnest(h), 6) + 0.0 AS y FROM r WHERE t >= 0"""
)
def lstm_outputs(spark, sf_dir):
    """One direction of a chain of four cells."""
    return _shown(models.outputs(_frames(spark, sf_dir), "vec_id", "frames", models.lstm, _stored(spark, {n: n for n in ("input", "hidden", "bias")})))


@query(f"""WITH {_X}, p AS (SELECT vec_id, 0 AS t, c, avg(v) AS v FROM x GROUP BY vec_id, c), {_layer("h", "p", "first", 5)}, a AS (SELECT vec_id, t, c, greatest(v, 0) AS v FROM h), {_layer("o", "a", "second", 3)} {_OUT} o""")
def pooled_scores(spark, sf_dir):
    w = _stored(spark, {f"{new}.{p}": f"{old}.{p}" for new, old in (("hidden", "first"), ("classifier", "second")) for p in ("weight", "bias")})
    return _shown(models.outputs(_frames(spark, sf_dir), "vec_id", "frames", models.pooled_classifier, w))

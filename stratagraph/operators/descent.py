"""Gradient descent on embeddings as relations: no task holds a model, and no step holds more than its batch.

Parameters are rows ``config, kind, id, v, acc``: a vector and its AdaGrad sum for every entity (E), relation (R) and
point in time (T) of every configuration. A step joins a batch with the vectors it names, adds up gradients by key,
first inside tasks, and joins the sums back. All configurations take their steps together. Each negative is compared with
its own positive. Steps are checkpointed, so a lost executor costs one.

``kinds`` of models: the plain scores of ``scoring``; ``eai_tcomplex`` adds the cosine of features, ``chkg`` the effect along
trees, ``inductive`` leaves unseen entities out of training and makes their vectors from features afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.columns import normalised, uniform
from stratagraph.operators import kg, ordinals, projection
from stratagraph.shipping import ship
from stratagraph.sources.steps import step

REAL = ("transe", "distmult", "tuckert")
TIMED = ("tcomplex", "tuckert", "eai_tcomplex", "inductive", "chkg")
CONFIG = "config string, model string, dim int, negatives int, margin double"


def initial(configs: DataFrame, entities: DataFrame, relations: DataFrame, times: int, seed: int = 42) -> DataFrame:
    """Drawn vectors, the same for every configuration of one size; ``entities`` and ``relations`` have ``id``."""
    kinds = [entities.select(F.lit("E").alias("kind"), F.col("id").cast("long").alias("id")), relations.select(F.lit("R").alias("kind"), F.col("id").cast("long").alias("id")), configs.sparkSession.range(times).select(F.lit("T").alias("kind"), "id")]
    rows = configs.crossJoin(kinds[0].unionByName(kinds[1]).unionByName(kinds[2])).where((F.col("kind") != "T") | F.col("model").isin(*TIMED))
    width = F.when(F.col("model").isin(*REAL), F.col("dim")).otherwise(2 * F.col("dim"))
    scale = F.when(F.col("kind") == "T", F.when(F.col("model") == "tuckert", 0.2).otherwise(0.5)).otherwise(1.0) * 0.5 / F.sqrt("dim") * 12**0.5
    places = F.transform(F.sequence(F.lit(0), width - 1), lambda i: (uniform(F.pmod(F.xxhash64(F.lit(seed), F.col("kind"), F.col("id"), i), F.lit(1 << 30))) - 0.5) * scale)
    return rows.select("config", "model", "kind", "id", places.alias("v"), F.transform(places, lambda _: F.lit(0.0)).alias("acc"))


def pair_gradients(model: str, h: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores, and their gradients by head, relation (with time added) and tail, row by row."""
    if model == "transe":
        off = h + w - t
        s = -np.sign(off)
        return -np.abs(off).sum(1), s, s, -s
    if model in ("distmult", "tuckert"):
        return (h * w * t).sum(1), w * t, h * t, h * w
    half = h.shape[1] // 2
    hz, wz, tz = (x[:, :half] + 1j * x[:, half:] for x in (h, w, t))
    flat = lambda z: np.concatenate([z.real, z.imag], axis=1)
    if model == "rotate":
        n = np.abs(wz) + 1e-12
        unit = wz / n
        off = hz * unit - tz
        by_unit = -2 * off * hz.conj()
        along = by_unit.real * unit.real + by_unit.imag * unit.imag  # only what turns the unit vector changes the score
        return -(np.abs(off) ** 2).sum(1), flat(-2 * off * unit.conj()), flat((by_unit - along * unit) / n), flat(2 * off)
    return (hz * wz * tz.conj()).sum(1).real, flat(tz * wz.conj()), flat(tz * hz.conj()), flat(hz * wz)


def _bonus(model: str, weight: float, h: dict, t: dict) -> np.ndarray | float:
    if model == "eai_tcomplex":
        return weight * (h["f"] * t["f"]).sum(1)
    if model == "chkg":
        return weight * np.where(h["tree"] == t["tree"], np.maximum(0, 1 - np.abs(h["norm"] - t["norm"])), 0)
    return 0.0


def _gradient_rows(weight: float):
    """A function on Arrow batches: gradients of the rows with a positive hinge, added up by parameter inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def add(config: str, kind: str, ids: np.ndarray, g: np.ndarray) -> None:
            own, at = np.unique(ids, return_inverse=True)
            total = np.zeros((len(own), g.shape[1]))
            np.add.at(total, at, g)
            for i, row in zip(own.tolist(), total, strict=True):
                key = config, kind, i
                sums[key] = sums[key] + row if key in sums else row

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for config in table.column("config").unique().to_pylist():
                part = table.filter(pa.compute.equal(table.column("config"), config)).combine_chunks()
                matrix = lambda c, part=part: np.asarray(part.column(c).combine_chunks().flatten()).reshape(part.num_rows, -1)
                column = lambda c, part=part: part.column(c).to_numpy()
                side = lambda p, matrix=matrix, column=column: {"f": matrix(f"{p}_f"), "tree": column(f"{p}_tree"), "norm": column(f"{p}_norm")}
                model, margin = part.column("model")[0].as_py(), part.column("margin")[0].as_py()
                h, t, n, w = matrix("h_v"), matrix("t_v"), matrix("n_v"), matrix("r_v")
                if model in TIMED:
                    w = w + matrix("x_v")
                pos, ph, pw, pt = pair_gradients(model, h, w, t)
                neg, nh, nw, nt = pair_gradients(model, h, w, n)
                loss = margin + neg - pos + _bonus(model, weight, side("h"), side("n")) - _bonus(model, weight, side("h"), side("t"))
                on = loss > 0
                add(config, "L", np.zeros(1, np.int64), np.array([[loss[on].sum(), len(loss)]]))
                if on.any():
                    add(config, "E", column("h")[on], (nh - ph)[on])
                    add(config, "E", column("t")[on], -pt[on])
                    add(config, "E", column("neg")[on], nt[on])
                    add(config, "R", column("r")[on], (nw - pw)[on])
                    if model in TIMED:
                        add(config, "T", column("tau")[on], (nw - pw)[on])
        if sums:
            config, kind, ids = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(config), pa.array(kind), pa.array(ids, pa.int64()), pa.array([g.tolist() for g in sums.values()])], names=["config", "kind", "id", "g"])

    return run


def one_step(params: DataFrame, configs: DataFrame, batch: DataFrame, entities: DataFrame, width: int, lr: float = 0.1, reg: float = 0.001, weight: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Parameters after one batch, and ``config, loss, pairs``.

    ``batch`` has ``h, r, t, tau, j, neg``; a configuration takes its first negatives of each. ``entities`` has ``id, f, tree,
    norm, seen``: features at unit length, the topmost ancestor's number (negative and different where there is none) and
    the norm in the ball. ``width`` is the largest vector. Only rows that a gradient touches move.
    """
    e = params.where("kind = 'E'").join(entities, "id")
    side = lambda p, key: e.select("config", F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("v", "f", "tree", "norm", "seen")])
    rows = configs.crossJoin(batch).where("j < negatives")
    rows = rows.join(side("h", "h"), ["config", "h"]).join(side("t", "t"), ["config", "t"]).join(side("n", "neg"), ["config", "neg"])
    rows = rows.where("model <> 'inductive' OR (h_seen AND t_seen AND n_seen)").drop("h_seen", "t_seen", "n_seen")
    other = lambda kind, p, key: params.where(F.col("kind") == kind).select("config", F.col("id").alias(key), F.col("v").alias(f"{p}_v"))
    rows = rows.join(other("R", "r", "r"), ["config", "r"]).join(other("T", "x", "tau"), ["config", "tau"], "left")
    longs = [F.col(c).cast("long").alias(c) for c in ("h", "r", "t", "tau", "neg")]
    rows = rows.select("config", "model", "margin", *longs, *[f"{p}_{c}" for p in "htn" for c in ("v", "f", "tree", "norm")], "r_v", "x_v")
    ship(params.sparkSession)
    grads = rows.mapInArrow(_gradient_rows(weight), "config string, kind string, id long, g array<double>")
    grads = step(grads.groupBy("config", "kind", "id").agg(F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(max(width, 2))]).alias("g")))
    loss = grads.where("kind = 'L'").join(configs, "config").select("config", F.col("g")[0].alias("loss"), F.col("g")[1].alias("pairs"), (F.col("g")[1] / F.col("negatives")).alias("rows"))
    moved = params.join(grads.where("kind <> 'L'"), ["config", "kind", "id"], "left").join(loss.select("config", "rows"), "config", "left")
    # a slope has the length of its vector: shorter ones of other configurations are cut
    slope = F.zip_with("v", F.slice("g", F.lit(1), F.size("v")), lambda v, g: g / F.col("rows") + reg * v)
    moved = moved.withColumn("s", F.when(F.col("g").isNotNull(), slope)).withColumn("acc", F.when(F.col("s").isNotNull(), F.zip_with("acc", "s", lambda a, s: a + s * s)).otherwise(F.col("acc")))
    delta = F.zip_with("s", "acc", lambda s, a: lr * s / (F.sqrt(a) + 1e-8))
    moved = moved.withColumn("v", F.when(F.col("s").isNotNull(), F.zip_with("v", delta, lambda v, x: v - x)).otherwise(F.col("v")))
    on_ball = (F.col("model") == "transe") & (F.col("kind") == "E")
    moved = moved.select("config", "model", "kind", "id", F.when(on_ball, normalised(F.col("v"))).otherwise(F.col("v")).alias("v"), "acc")
    return step(moved), loss.select("config", "loss", "pairs")


def batches(quads: DataFrame, entities: DataFrame, epochs: int, per_epoch: int, negatives: int) -> list[DataFrame]:
    """The batches of all epochs: quads dealt out anew in each by a hash of their number, with negatives drawn by smoothed counts."""
    rows = step(ordinals.numbered(quads.select("h", "r", "t", "tau"), ["tau", "h", "r", "t"], "pos"))
    n = rows.count()
    chances = step(kg.negative_probabilities(rows, entities.select("id")))
    out = []
    for epoch in range(epochs):
        drawn = kg.negative_samples(rows.select((F.col("pos") + epoch * n).alias("pos_id")), chances, negatives).select((F.col("pos_id") - epoch * n).alias("pos"), "j", "neg")
        dealt = step(rows.join(drawn, "pos").withColumn("part", F.pmod(F.xxhash64(F.lit(epoch), "pos"), F.lit(per_epoch))))
        out += [dealt.where(F.col("part") == b) for b in range(per_epoch)]
    return out


def train(quads: DataFrame, configs: DataFrame, entities: DataFrame, relations: DataFrame, times: int, epochs: int, per_epoch: int = 1, lr: float = 0.1, weight: float = 0.1) -> tuple[DataFrame, list[dict[str, float]]]:
    """Trained parameters, and the mean loss of every configuration in every epoch. Configurations are few; they are named on the driver."""
    rows = configs.collect()
    width, most = max(r.dim * (1 if r.model in REAL else 2) for r in rows), max(r.negatives for r in rows)
    params = step(initial(configs, entities, relations, times))
    history, entities = [], step(entities)
    for at, batch in enumerate(batches(quads, entities, epochs, per_epoch, most)):
        params, loss = one_step(params, configs, batch, entities, width, lr, weight=weight)
        found = {r.config: (r.loss, r.pairs) for r in loss.collect()}
        if at % per_epoch == 0:
            total = {r.config: [0.0, 0.0] for r in rows}
        for name, (x, n) in found.items():
            total[name][0] += x
            total[name][1] += n
        if at % per_epoch == per_epoch - 1:
            history.append({name: x / max(n, 1.0) for name, (x, n) in total.items()})
    unseen = params.where("kind = 'E' AND model = 'inductive'").join(entities.select("id", "f", "seen"), "id")
    for r in (r for r in rows if r.model == "inductive"):
        own = unseen.where(F.col("config") == r.config).withColumn("y", F.when(F.col("seen"), F.col("v")))
        made = projection.project(own, "f", "y", projection.solved(projection.moments(own, "f", "y"), ridge=1e-3))
        params = step(params.where(~((F.col("config") == r.config) & (F.col("kind") == "E"))).unionByName(made.select("config", "model", "kind", "id", F.col("y").alias("v"), "acc")))
    return params, history


def vectors(params: DataFrame, config: str, model: str, entities: DataFrame, heads_and_times: DataFrame, weight: float = 0.1) -> tuple[DataFrame, DataFrame, str]:
    """``h, r, tau, q`` of the asked ``h, r, tau``, ``id, c`` of all entities, and how they meet (``blocks.scores``)."""
    of = lambda kind: params.where((F.col("config") == config) & (F.col("kind") == kind)).select("id", "v")
    e = of("E").join(entities, "id")
    asked = heads_and_times.join(e.select(F.col("id").alias("h"), F.col("v").alias("hv"), "f", "tree", "norm"), "h").join(of("R").select(F.col("id").alias("r"), F.col("v").alias("rv")), "r")
    w = F.col("rv")
    if model in TIMED:
        asked = asked.join(of("T").select(F.col("id").alias("tau"), F.col("v").alias("tv")), "tau")
        w = F.zip_with("rv", "tv", lambda a, b: a + b)
    q = _folded(model, F.col("hv"), w)
    if model == "eai_tcomplex":
        return asked.select("h", "r", "tau", F.concat(q, F.transform("f", lambda x: weight * x)).alias("q")), e.select("id", F.concat("v", "f").alias("c")), "dot"
    if model == "chkg":
        more = F.array(F.lit(weight), F.col("tree").cast("double"), F.col("norm"))
        return asked.select("h", "r", "tau", F.concat(q, more).alias("q")), e.select("id", F.concat("v", F.array(F.col("tree").cast("double"), F.col("norm"))).alias("c")), "dot_effect"
    return asked.select("h", "r", "tau", q.alias("q")), e.select("id", F.col("v").alias("c")), {"transe": "l1", "rotate": "l2"}.get(model, "dot")


def _folded(model: str, h: Column, w: Column) -> Column:
    if model == "transe":
        return F.zip_with(h, w, lambda a, b: a + b)
    if model in REAL:
        return F.zip_with(h, w, lambda a, b: a * b)
    half = (F.size(h) / 2).cast("int")
    first = lambda x: F.slice(x, F.lit(1), half)
    second = lambda x: F.slice(x, half + 1, half)
    re, im = first(w), second(w)
    if model == "rotate":
        n = F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b) + 1e-12)
        re, im = F.zip_with(re, n, lambda a, b: a / b), F.zip_with(im, n, lambda a, b: a / b)
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    return F.concat(F.zip_with(times(first(h), re), times(second(h), im), lambda x, y: x - y), F.zip_with(times(first(h), im), times(second(h), re), lambda x, y: x + y))

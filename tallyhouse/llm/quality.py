"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text is reduced to a few statistics. Random Fourier features of them approximate a Gaussian kernel, so ridge
regression on them is a kernel machine whose normal equations are sums over rows: tasks add up their share, and one small
matrix reaches the driver. Rows kept apart from the fit calibrate it: pool-adjacent-violators turns raw scores into the
share of good documents at that score.

The fit reads at most about ``sample`` labelled rows, picked by a hash of the id; scoring reads every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import map_batches, materialize, table, texts

#: Labelled rows that the fit reads at most, in expectation; random features; their width; the ridge.
SAMPLE, FEATURES, GAMMA, RIDGE = 20_000, 256, 0.04, 1e-3
NAMES = ("log_chars", "log_words", "word_length", "upper", "digits", "spaces", "stops", "marks", "odd", "non_ascii", "distinct_words", "distinct_lines", "log_line", "first_word_share", "marked_ends", "caps_words")

_UPPER, _DIGITS = np.arange(65, 91), np.arange(48, 58)
_STOPS, _MARKS = np.frombuffer(b".,;:'\"()-?", np.uint8), np.frombuffer(b"!|", np.uint8)
_ODD = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of NAMES; all finite, zeros for an empty one."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words, lines = text.split(), text.split("\n")
    count = len(words) or 1
    ends = sum(map(n.__getitem__, (46, 63))) / count
    first = words.count(words[0]) / count if words else 0.0
    return [
        np.log1p(size), np.log1p(len(words)), min(size / count, 60.0),
        n[_UPPER].sum() / size, n[_DIGITS].sum() / size, (n[9] + n[10] + n[13] + n[32]) / size, n[_STOPS].sum() / size, n[_MARKS].sum() / size, n[_ODD].sum() / size, n[128:].sum() / size,
        len(set(words)) / count, len(set(lines)) / len(lines), np.log1p(size / len(lines)), first, min(ends, 2.0), min(n[_UPPER].sum() / count, 8.0),
    ]


def _features(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8) @ model["waves"] + model["phases"]
    return np.hstack([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(x), 1))])


def _stats_of(batch) -> np.ndarray:
    return np.array([statistics(x) for x in texts(batch)], dtype=float).reshape(batch.num_rows, len(NAMES))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising map from score to the share of label 1; ties in score are one point."""
    at, which = np.unique(score, return_inverse=True)
    weight = np.bincount(which).astype(float)
    mean = np.bincount(which, weights=label) / weight
    blocks: list[list[float]] = []  # sum of score * weight, sum of label, weight
    for s, m, w in zip(at, mean, weight):
        blocks.append([s * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a, b, c = blocks.pop()
            blocks[-1][0] += a
            blocks[-1][1] += b
            blocks[-1][2] += c
    return np.array([a / c for a, _, c in blocks]), np.array([b / c for _, b, c in blocks])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 11) -> dict:
    """The model from rows of ``labels`` (doc_id, quality) that aren't held out. Without both labels it scores every text with their mean, or 0.5 without any."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("label"))
    share = min(1.0, sample / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # picked: about ``sample`` rows at most
    calibrates = (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0).alias("calibrates")
    rows = rows.select("text", "label", calibrates)
    x = materialize(map_batches(rows, "x array<double>, label double, calibrates boolean", lambda: lambda b: [list(_stats_of(b)), b.column("label"), b.column("calibrates")]).repartition(8), "statistics")
    of = [F.element_at("x", i + 1) for i in range(len(NAMES))]
    sums = x.agg(F.count("*").alias("n"), F.avg("label").alias("label"), *[f(c).alias(f"{name}{i}") for i, c in enumerate(of) for name, f in (("mean", F.avg), ("spread", F.stddev_pop))]).first()
    model = {"constant": 0.5 if sums["label"] is None else float(sums["label"])}
    if sums["label"] in (None, 0.0, 1.0):
        return model
    draw = np.random.default_rng(seed)
    model |= {"mean": np.array([sums[f"mean{i}"] for i in range(len(NAMES))]), "spread": np.array([sums[f"spread{i}"] or 1.0 for i in range(len(NAMES))]), "waves": draw.normal(0, np.sqrt(2 * gamma), (len(NAMES), features)), "phases": draw.uniform(0, 2 * np.pi, features)}

    def add(batches):
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            if b.num_rows:
                z = _features(np.array(b.column("x").to_pylist()), model)
                total += z.T @ np.hstack([z, b.column("label").to_numpy()[:, None]])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((features + 1, features + 2))
    for i, j, s in x.where("not calibrates").select("x", "label").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        total[i, j] = s
    model["weights"] = np.linalg.solve(total[:, :-1] + ridge * max(1.0, total[-1, -2]) * np.eye(features + 1) / features, total[:, -1])
    apart = x.where("calibrates").select("x", "label").toPandas()  # a quarter of the sample
    if len(apart):
        model["knots"], model["shares"] = isotonic(np.round(_features(np.stack(apart["x"]), model) @ model["weights"], 9), apart["label"].to_numpy())
    return model


def apply_model(x: np.ndarray, model: dict) -> np.ndarray:
    if "weights" not in model:
        return np.full(len(x), model["constant"])
    raw = _features(x, model) @ model["weights"]
    return np.clip(np.interp(raw, model["knots"], model["shares"]) if "knots" in model else raw, 0.0, 1.0)


def scores(docs: DataFrame, model: dict, bound: float = 0.7) -> DataFrame:
    """All columns of ``docs``, and score and predicted (1 from ``bound`` on), for every row. A null text is scored as an empty one."""
    from pyspark.sql import types as T

    taken = {"score", "predicted"}
    kept = docs.select(*[c for c in docs.columns if c not in taken])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def step(batch):
            s = apply_model(_stats_of(batch), model)
            return [*batch.columns, s, (s >= bound).astype(np.int32)]

        return step

    return map_batches(kept, schema, make)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

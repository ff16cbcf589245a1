"""Price model: training, prediction with intervals, additive explanations."""

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import dropped, shared_dir, stored
from .clean import align_to_schema, in_target_range
from .features import global_mean, impute, leave_one_out, local_stats, modes, with_local_price
from .reports import top_features
from .stats import conformal_radius, errors, medians, quantiles, residual_quantiles


@dataclass
class PriceModel:
    """A fitted pipeline on the log price, with what prediction needs besides."""

    pipeline: PipelineModel
    numeric: list[str]
    categorical: list[str]
    numbers: dict[str, float]
    categories: dict[str, str]
    stats: DataFrame
    mean: DataFrame
    eps: float = 0.0
    low: float = 0.0
    high: float = 0.0
    metrics: dict[str, float] = field(default_factory=dict)
    spread: tuple | None = None  # trees, residuals' cuts, and shares of residuals by tree, leaf and bin


def _prepared(df: DataFrame, numeric: list[str], categorical: list[str], numbers: dict, categories: dict) -> DataFrame:
    missing = [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numeric]
    aligned = align_to_schema(df, numeric, categorical)
    return impute(aligned.select("*", *missing), numbers, categories)


def train(train_rows: DataFrame, valid_rows: DataFrame, numeric: list[str], categorical: list[str], trees: int = 100, depth: int = 6, step: float = 0.1, q: float = 0.9, conditional: bool = False) -> PriceModel:
    """Gradient-boosted trees on the log of prices in range, with leave-one-out local
    prices, medians and modes for what is missing, and the conformal radius and errors on
    `valid_rows`. Missing numbers also get a flag each. conditional: whether residuals are kept
    by leaves, for `predict`'s intervals of that name."""
    seen = stored(in_target_range(train_rows), "training")
    rows = stored(leave_one_out(seen), "training")  # read by medians, modes and each tree
    numeric = [*numeric, "local_avg_price_rub", "local_density_count"]
    stats, mean = stored(local_stats(seen), "prices"), stored(global_mean(seen), "mean")
    numbers = medians(rows, numeric).first().asDict()
    found = {r["name"]: r["value"] for r in modes(rows, categorical).collect()}  # a row for each column
    categories = {c: found.get(c) or "" for c in categorical}
    ready = _prepared(rows, numeric, categorical, numbers, categories).withColumn("label", tx.log_target("price_rub"))
    inputs = [*numeric, *[f"{c}_missing" for c in numeric]]
    stages = [Imputer(inputCols=numeric, outputCols=numeric, strategy="median")]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_1h" for c in categorical])]
    stages += [VectorAssembler(inputCols=[*inputs, *[f"{c}_1h" for c in categorical]], outputCol="features"), GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=step, seed=7, maxBins=64)]
    model = PriceModel(Pipeline(stages=stages).fit(ready), numeric, categorical, numbers, categories, stats, mean)
    checked = predict(model, in_target_range(valid_rows)).select(F.col("price_rub").cast("double").alias("truth"), "prediction_rub")
    checked = stored(checked, "checked")
    logs = checked.select(tx.log_target("truth").alias("y"), tx.log_target("prediction_rub").alias("p"))
    model.eps = conformal_radius(logs, "y", "p", q).first()[0] or 0.0
    ends = residual_quantiles(checked, "truth", "prediction_rub", 1 - q, q).first()
    model.low, model.high = ends["low"] or 0.0, ends["high"] or 0.0
    model.metrics = errors(checked, "truth", "prediction_rub").first().asDict()
    if conditional:
        model.spread = leaf_residuals(model, in_target_range(valid_rows))
    dropped(seen, rows, checked)
    return model


def _leaves(x: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """The leaf of a tree that each row comes to."""
    at = np.zeros(len(x), int)
    while (go := t["left"][at] >= 0).any():
        r, a = np.flatnonzero(go), at[go]
        v = x[r, t["feature"][a]]
        chosen = (t["set"][a] >> v.astype(np.uint64)) & np.uint64(1) == 1
        at[go] = np.where(np.where(t["set"][a] > 0, chosen, v <= t["at"][a]), t["left"][a], t["right"][a])
    return at


def leaf_residuals(model: PriceModel, rows: DataFrame, bins: int = 64) -> tuple:
    """How the residuals (in logs) of calibration `rows` spread in each leaf of each tree:
    (trees, cuts, shares). A leaf's sketch is a histogram over `bins` ranges with as many
    residuals each, so sketches of tasks and leaves add up. What is gathered has the model's
    size: trees times leaves times bins. `shares` holds a whole residual more in each leaf, dealt
    by all rows' residuals, so that a leaf without rows says what all rows say."""
    spark = model.stats.sparkSession
    path = f"{shared_dir(spark)}/listinglab/trees-{uuid.uuid4().hex}"
    trees = [t for _, t in _trees(model, path)]
    out = predict(model, rows).select(vector_to_array("features").alias("x"), (tx.log_target("price_rub") - F.col("prediction")).alias("r"))
    out = stored(out, "residuals")
    cuts = np.array(quantiles(out, {"r": F.col("r")}, [k / bins for k in range(bins + 1)])["r"], float)
    held = spark.sparkContext.broadcast((trees, cuts))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, cuts = held.value
        sums = [np.zeros((len(t["left"]), len(cuts) - 1), np.int64) for t in trees]
        for b in batches:
            if len(b):
                x, bin_ = np.stack(b["x"].to_list()), np.clip(np.searchsorted(cuts, b["r"].to_numpy(), side="right") - 1, 0, len(cuts) - 2)
                for t, n in zip(trees, sums, strict=True):
                    np.add.at(n, (_leaves(x, t), bin_), 1)
        for k, n in enumerate(sums):
            leaf, bin_ = np.nonzero(n)
            yield pd.DataFrame({"tree": np.full(len(leaf), k), "leaf": leaf, "bin": bin_, "n": n[leaf, bin_]})

    sums = out.mapInPandas(counted, "tree long, leaf long, bin long, n long").groupBy("tree", "leaf", "bin").agg(F.sum("n").alias("n")).toPandas()
    dropped(out)
    shares = []
    for k, t in enumerate(trees):
        n = np.full((len(t["left"]), bins), 1.0 / bins)
        part = sums[sums.tree == k]
        np.add.at(n, (part.leaf.to_numpy(int), part.bin.to_numpy(int)), part.n.to_numpy(float))
        shares.append(n / n.sum(axis=1, keepdims=True))
    return trees, cuts, shares


def conditional_interval(model: PriceModel, predicted: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """An interval for each row by the residuals of rows that come to the same leaves: the
    shares of its leaves are averaged over the trees, those that differ from all rows' spread
    weighing more, and the quantiles of that spread are added to its logarithm. `predicted`: rows of `predict`; the model was trained with `conditional`."""
    if model.spread is None:
        raise ValueError("train with conditional=True")
    held = model.stats.sparkSession.sparkContext.broadcast(model.spread)

    @F.pandas_udf("array<double>")
    def ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, cuts, shares = held.value
        for s in batches:
            x = np.stack(s.to_list()) if len(s) else np.empty((0, 1))
            mean, total = np.zeros((len(x), len(cuts) - 1)), np.zeros((len(x), 1))
            for t, n in zip(trees, shares, strict=True):
                told = (n * np.log(n * n.shape[1])).sum(axis=1) ** 2 + 1e-6  # what a leaf tells beyond all rows' spread
                at = _leaves(x, t)
                mean += n[at] * told[at][:, None]
                total += told[at][:, None]
            upto = np.concatenate([np.zeros((len(x), 1)), np.cumsum(mean, axis=1)], axis=1) / total
            yield pd.Series([[float(np.interp(q, u, cuts)) for q in (low, high)] for u in upto], dtype=object)

    rows = predicted.withColumn("_e", ends(vector_to_array("features")))
    fixed = tx.repair_interval(F.exp(F.col("prediction") + F.col("_e")[0]), F.exp("prediction"), F.exp(F.col("prediction") + F.col("_e")[1]))
    return rows.withColumns({"interval_low_rub": fixed["low"], "interval_high_rub": fixed["high"]}).drop("_e")


def predict(model: PriceModel, df: DataFrame, interval: str = "conformal") -> DataFrame:
    """`df` with prediction_rub and an interval around it: "conformal", of `eps` in logs
    either way, "quantile", by the quantiles of signed errors, or "both", the second as
    quantile_low_rub and quantile_high_rub: the trees run once. "conditional" asks the
    residuals of a row's own leaves, see `conditional_interval`."""
    local = with_local_price(df, model.stats, model.mean)
    out = model.pipeline.transform(_prepared(local, model.numeric, model.categorical, model.numbers, model.categories))
    low, high = F.exp(F.col("prediction") - model.eps), F.exp(F.col("prediction") + model.eps)
    if interval == "quantile":
        return quantile_interval(out.withColumn("prediction_rub", F.exp("prediction")), model.low, model.high)
    fixed = tx.repair_interval(low, F.exp("prediction"), high)
    out = out.withColumns({"prediction_rub": F.exp("prediction"), "interval_low_rub": fixed["low"], "interval_high_rub": fixed["high"]})
    if interval == "conditional":
        return conditional_interval(model, out)
    if interval != "both":
        return out
    pair = tx.repair_interval(F.col("prediction_rub") + model.low, F.col("prediction_rub"), F.col("prediction_rub") + model.high)
    return out.withColumns({"quantile_low_rub": pair["low"], "quantile_high_rub": pair["high"]})


def quantile_interval(df: DataFrame, low: float, high: float) -> DataFrame:
    """The interval from two quantiles of signed calibration errors."""
    fixed = tx.repair_interval(F.col("prediction_rub") + low, F.col("prediction_rub"), F.col("prediction_rub") + high)
    return df.withColumns({"interval_low_rub": fixed["low"], "interval_high_rub": fixed["high"]})


def feature_names(model: PriceModel) -> list[str]:
    """Names of the assembled vector's places."""
    names = [*model.numeric, *[f"{c}_missing" for c in model.numeric]]
    if model.categorical:
        for c, labels in zip(model.categorical, model.pipeline.stages[1].labelsArray, strict=True):
            names += [f"{c}_{v}" for v in labels]
    return names


def _trees(model: PriceModel, path: str) -> list[tuple[float, dict[str, np.ndarray]]]:
    """The fitted trees as arrays, from their saved form: a table of nodes."""
    gbt, spark = model.pipeline.stages[-1], model.stats.sparkSession
    gbt.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()  # trees are of bounded depth
    out = []
    for t, w in enumerate(gbt.treeWeights):
        n = nodes[nodes.treeID == t].sort_values("id")
        split = n["split"].to_list()
        kinds, cuts = [s["numCategories"] for s in split], [s["leftCategoriesOrThreshold"] for s in split]
        out.append((w, {
            "value": n.prediction.to_numpy(),
            "left": n.leftChild.to_numpy(),
            "right": n.rightChild.to_numpy(),
            "cover": n.rawCount.to_numpy(),
            "feature": np.array([s["featureIndex"] for s in split]),
            "at": np.array([c[0] if k < 0 and len(c) else 0.0 for k, c in zip(kinds, cuts, strict=True)]),
            # Categories that go left, as bits; 0 for splits by a threshold.
            "set": np.array([sum(1 << int(x) for x in c) if k >= 0 else 0 for k, c in zip(kinds, cuts, strict=True)], np.uint64),
        }))
    return out


def leaf_paths(tree: dict[str, np.ndarray]) -> list[tuple[float, float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """For each leaf its value, its share of the training rows, and for each feature on its path:
    the feature, the product of the shares of rows that its splits send this way, and the splits
    (node, whether left)."""
    out, cover = [], tree["cover"].astype(float)
    todo: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
    while todo:
        node, way = todo.pop()
        if tree["left"][node] < 0:
            by: dict[int, list] = {}
            for at, left in way:
                share = cover[tree["left" if left else "right"][at]] / cover[at]
                entry = by.setdefault(int(tree["feature"][at]), [1.0, []])
                entry[0] *= share
                entry[1].append((at, left))
            out.append((float(tree["value"][node]), cover[node] / cover[0], [(f, z, splits) for f, (z, splits) in by.items()]))
        else:
            todo += [(int(tree["left"][node]), [*way, (node, True)]), (int(tree["right"][node]), [*way, (node, False)])]
    return out


def subset_weights(follows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The Shapley values of the features on a leaf's path, for a leaf of value 1.

    follows (rows, features): 1 where a row goes the leaf's way at all of a feature's splits;
    shares: how many training rows do. A subset of known features leads here with the product of
    `follows` of the known and `shares` of the others, so sums over subsets of each size are
    the coefficients of a product of m linear factors. One factor is divided out for each
    feature: the square of m steps, not 2^m."""
    rows, m = follows.shape
    sums = np.zeros((rows, m + 1))
    sums[:, 0] = 1.0
    for i in range(m):
        sums[:, 1:] = sums[:, 1:] * shares[i] + sums[:, :-1] * follows[:, i : i + 1]
        sums[:, 0] *= shares[i]
    weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty((rows, m))
    for j in range(m):
        rest, goes = np.zeros((rows, m + 1)), follows[:, j] > 0
        for k in range(m - 1, -1, -1):  # divided by (share + t) from the top, or by the share alone
            rest[goes, k] = sums[goes, k + 1] - shares[j] * rest[goes, k + 1]
        rest[~goes, :m] = sums[~goes, :m] / shares[j]
        out[:, j] = (follows[:, j] - shares[j]) * (rest[:, :m] @ weight)
    return out


@dataclass
class Block:
    """A subtree of a few splits with the way to it. A row's state in it is a number: a bit for each
    feature on the way (whether the row follows it at all of that feature's splits) and one for
    each split of the subtree (whether it goes left). `values` has what the subtree's leaves
    give to each of `features` in each state."""

    way: list[list[tuple[int, bool]]]
    splits: list[int]
    features: list[int]
    values: np.ndarray


def blocks(w: float, tree: dict[str, np.ndarray], leaves: list, height: int = 2, most_bits: int = 10) -> tuple[list[Block], list]:
    """The contributions of a tree of weight `w` as tables: a block for each subtree of at most
    `height` splits one above the other, so that a row looks a few numbers up instead of
    working out each leaf. Leaves of a block that would have more than `most_bits` bits come back
    as they are."""
    left, right = tree["left"], tree["right"]
    leaf_at: dict[int, tuple] = {}
    for leaf in leaves:
        steps = {at: goes for _, _, splits in leaf[2] for at, goes in splits}
        node = 0
        while left[node] >= 0:
            node = int((left if steps[node] else right)[node])
        leaf_at[node] = leaf

    def inside(node: int) -> list[int]:
        return [] if left[node] < 0 else [node, *inside(int(left[node])), *inside(int(right[node]))]

    def ends(node: int) -> list[int]:
        return [node] if left[node] < 0 else [*ends(int(left[node])), *ends(int(right[node]))]

    def levels(node: int) -> int:
        return 0 if left[node] < 0 else 1 + max(levels(int(left[node])), levels(int(right[node])))

    out, rest = [], []
    todo: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
    while todo:
        top, way = todo.pop()
        if levels(top) > height:
            todo += [(int(left[top]), [*way, (top, True)]), (int(right[top]), [*way, (top, False)])]
            continue
        by: dict[int, list[tuple[int, bool]]] = {}
        for at, goes in way:
            by.setdefault(int(tree["feature"][at]), []).append((at, goes))
        splits, found = inside(top), [leaf_at[n] for n in ends(top)]
        bits = len(by) + len(splits)
        if bits > most_bits:
            rest += found
            continue
        states = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1 == 1  # (states, bits)
        on_way, goes_left = dict(zip(by, states.T, strict=False)), dict(zip(splits, states.T[len(by) :], strict=True))
        features = sorted({f for _, _, path in found for f, _, _ in path})
        values = np.zeros((len(features), len(states)))
        for value, _, path in found:
            if path:
                follows = np.ones((len(states), len(path)), bool)
                for k, (f, _, steps) in enumerate(path):
                    if f in on_way:
                        follows[:, k] = on_way[f]
                    for at, goes in steps:
                        if at in goes_left:
                            follows[:, k] &= goes_left[at] == goes
                given = w * value * subset_weights(follows.astype(float), np.array([z for _, z, _ in path]))
                values[[features.index(f) for f, _, _ in path]] += given.T
        if features:
            out.append(Block(list(by.values()), splits, features, values))
    return out, rest


Tabled = list[tuple[float, dict[str, np.ndarray], float, list[Block], list]]


def tabled(trees: list[tuple[float, dict[str, np.ndarray], list]]) -> Tabled:
    """Trees (weight, arrays, leaf paths) with their base and their blocks."""
    return [(w, t, sum(w * value * cover for value, cover, _ in leaves), *blocks(w, t, leaves)) for w, t, leaves in trees]


def contributions(x: np.ndarray, trees: list[tuple[float, dict[str, np.ndarray], list]]) -> np.ndarray:
    """Exact additive contributions of rows `x` in the trees (weight, arrays, leaf paths); the
    last column is the base, the trees' mean over their training rows."""
    return looked_up(x, tabled(trees))


def looked_up(x: np.ndarray, trees: Tabled, at_once: int = 8192) -> np.ndarray:
    """`contributions` from the trees' tables, `at_once` rows at a time, which stay in the cache.
    Rows that follow the same features of the way to a leaf without a table share its values."""
    out = np.zeros((len(x), x.shape[1] + 1))
    for start in range(0, len(x), at_once):
        part = np.ascontiguousarray(x[start : start + at_once].T)
        n = part.shape[1]
        sums, taken = np.zeros((len(part) + 1, n)), np.empty(n)
        for w, t, base, tables, rest in trees:
            sums[-1] += base
            left = {}
            for node in np.flatnonzero(t["left"] >= 0).tolist():
                v = part[t["feature"][node]]
                left[node] = (t["set"][node] >> v.astype(np.uint64)) & np.uint64(1) == 1 if t["set"][node] else v <= t["at"][node]
            for b in tables:
                state = np.zeros(n, np.uint16)
                for k, steps in enumerate(b.way):
                    follows = left[steps[0][0]] == steps[0][1]
                    for at, goes in steps[1:]:
                        follows = follows & (left[at] == goes)
                    state |= follows.astype(np.uint16) << np.uint16(k)
                for k, at in enumerate(b.splits, len(b.way)):
                    state |= left[at].astype(np.uint16) << np.uint16(k)
                which = state.astype(np.intp)
                for f, values in zip(b.features, b.values, strict=True):
                    np.take(values, which, out=taken, mode="clip")
                    sums[f] += taken
            for value, _, path in rest:
                follows = np.ones((n, len(path)), bool)
                for k, (_, _, splits) in enumerate(path):
                    for node, goes_left in splits:
                        follows[:, k] &= left[node] == goes_left
                ways, same = np.unique(np.packbits(follows, axis=1, bitorder="little"), axis=0, return_inverse=True)
                kinds = np.unpackbits(ways, axis=1, count=len(path), bitorder="little").astype(float)
                given = w * value * subset_weights(kinds, np.array([z for _, z, _ in path]))
                sums[[f for f, _, _ in path]] += given[same.reshape(-1)].T
        out[start : start + at_once] = sums.T
    return out


def explain(model: PriceModel, predicted: DataFrame, path: str | None = None, n: int = 8) -> DataFrame:
    """`predicted` with base_value, prediction_internal, contributions and top_features. A
    feature's contribution is its Shapley value: what knowing it changes in the trees' mean
    prediction, averaged over all orders of features, where unknown splits are followed by the
    share of training rows that went each way. base_value plus all contributions is the
    prediction. `path`: where the trees are saved, a folder all executors share; a new one if
    unset."""
    path = path or f"{shared_dir(predicted.sparkSession)}/listinglab/trees-{uuid.uuid4().hex}"
    trees = model.stats.sparkSession.sparkContext.broadcast(tabled([(w, t, leaf_paths(t)) for w, t in _trees(model, path)]))
    names = feature_names(model)

    size = len(names)

    @F.arrow_udf("array<double>")
    def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            given = looked_up(s.flatten().to_numpy(zero_copy_only=False).reshape(len(s), size), trees.value)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * (size + 1)), pa.array(given.reshape(-1)))

    c = predicted.withColumn("_c", shares(vector_to_array("features")))
    named = F.array(*[F.lit(x) for x in names])
    pairs = F.transform(F.slice("_c", 1, size), lambda v, i: F.struct(F.get(named, i).alias("feature"), v.alias("contribution")))
    total = F.aggregate("_c", F.lit(0.0), lambda a, v: a + v)
    return c.withColumns({"base_value": F.element_at("_c", -1), "prediction_internal": total, "contributions": pairs, "top_features": top_features(pairs, n)}).drop("_c")

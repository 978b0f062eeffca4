"""Boosted trees as Spark ML grows them, in one barrier stage in place of some ten jobs a tree.

Loss, shrinkage, candidate splits (``BINS`` quantiles), the draw of rows for a tree and of features for a node, variance gain and leaf values are those of ``GBTClassifier``. Every task keeps its
rows' bins, one byte each, and its margins in memory; histograms are added up along a binary tree of sockets between the tasks, whose root chooses the splits. Of two siblings the smaller one's
histogram is counted, the other is the difference; features are counted a few at a time, by their common cell, and each one's histogram is the sum over the others' bins. Targets are fixed-point numbers and draws come from hashes, so neither partitions nor their order change the model.
"""

from __future__ import annotations

import json
import math
import secrets
import socket

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.sinks import shared_path

BINS = 32
#: Cells at most in which features are counted together: a node's cells should stay in the processor's cache.
CELLS = 1024
#: Rows by whose values candidate splits are placed, drawn by hash. (Spark ML takes 10,000.)
PLACED = 50_000
#: Targets are counted in units of 1 / UNIT; their sums are exact up to 2^53 units.
UNIT = float(1 << 20)
#: Rows that one task holds at most, at some 220 bytes each; with more of them Spark ML, which reads them from disk, trains.
HELD = 2_000_000
#: The parameters that are followed here.
KNOWN = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode"}
#: Seconds without a word from another task after which a task fails, and the stage with it.
SILENCE = 1800
_NODES = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("value", pa.float64()), ("weight", pa.float64()), ("count", pa.int64())])
_NODE = "struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def cuts_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Candidate splits of a feature: between all its values if they are few, else near its quantiles."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) > bins:
        part = np.cumsum(counts) * bins // (len(values) + 1)
        found, at = found, np.flatnonzero(part[1:] != part[:-1])
    else:
        at = np.arange(len(found) - 1)
    return (found[at] + found[at + 1]) / 2


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Evenly spread 64-bit numbers from keys (splitmix64)."""
    x = keys + np.uint64((salt * 0x9E3779B97F4A7C15) & int(_MASK))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Peers:
    """Sums and messages among the tasks of a barrier stage, along a binary tree of connections."""

    def __init__(self, context, token: bytes) -> None:
        rank, self.up, self.down = context.partitionId(), None, []
        hosts = [t.address.rsplit(":", 1)[0].strip("[]") for t in context.getTaskInfos()]
        family = socket.AF_INET6 if ":" in hosts[rank] else socket.AF_INET
        with socket.create_server(("", 0), family=family, backlog=8) as server:
            server.settimeout(SILENCE)
            ports = context.allGather(str(server.getsockname()[1]))
            if rank:
                parent = (rank - 1) // 2
                self.up = self._ready(socket.create_connection((hosts[parent], int(ports[parent])), SILENCE))
                self.up.sendall(token)
            while len(self.down) < sum(k < len(hosts) for k in (2 * rank + 1, 2 * rank + 2)):
                link = self._ready(server.accept()[0])
                said = bytearray(len(token))
                if self._fill(link, memoryview(said)) and secrets.compare_digest(bytes(said), token):
                    self.down.append(link)
                else:
                    link.close()

    @staticmethod
    def _ready(link: socket.socket) -> socket.socket:
        link.settimeout(SILENCE)
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return link

    @staticmethod
    def _fill(link: socket.socket, into: memoryview) -> bool:
        at = 0
        while at < len(into):
            n = link.recv_into(into[at:])
            if not n:
                return False
            at += n
        return True

    def _get(self, link: socket.socket, a: np.ndarray) -> np.ndarray:
        if a.size and not self._fill(link, memoryview(a).cast("B")):
            raise ConnectionError("another task of the training ended")
        return a

    def summed(self, a: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays at the root; what lies below at the others."""
        for link in self.down:
            a += self._get(link, np.empty_like(a))
        if self.up:
            self.up.sendall(a.tobytes())
        return a

    def told(self, a: np.ndarray) -> np.ndarray:
        """The root's array at all."""
        if self.up:
            self._get(self.up, a)
        for link in self.down:
            link.sendall(a.tobytes())
        return a

    def close(self) -> None:
        for link in [self.up, *self.down]:
            if link:
                link.close()


def best_splits(hist: np.ndarray, ratio: float, least: int, allowed: np.ndarray):
    """Of histograms (node, feature, bin, [rows of label 0, of label 1, sum of targets]): feature, bin and gain of each node's best split (feature -1: none), and the left side's three sums."""
    left = hist.cumsum(2)
    whole = left[:, :, -1:]
    right = whole - left
    rows = lambda h: h[..., 0] + h[..., 1]
    weight = lambda h: h[..., 0] + ratio * h[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 2] ** 2 / weight(left) + right[..., 2] ** 2 / weight(right) - whole[..., 2] ** 2 / weight(whole)) / weight(whole) / UNIT**2
    good = (rows(left) >= max(least, 1)) & (rows(right) >= max(least, 1)) & allowed[:, :, None]
    gain = np.where(good, gain, 0.0).reshape(len(hist), -1)
    at = gain.argmax(1)
    most = gain[np.arange(len(hist)), at]
    # Sums are exact, but differences of quotients are not.
    feature = np.where(most > 1e-12, at // hist.shape[2], -1)
    return feature, at % hist.shape[2], most, left.reshape(len(hist), -1, 3)[np.arange(len(hist)), at]


def grouped(sizes: list[int]) -> list[list[int]]:
    """Features to count together: the product of their numbers of bins is at most ``CELLS``."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for g in groups:
            if math.prod(sizes[k] for k in g) * sizes[f] <= CELLS:
                g.append(f)
                break
        else:
            groups.append([f])
    return groups


def grown(bins: np.ndarray, label: np.ndarray, key: np.ndarray, peers, ratio: float, params: dict, seed: int, sizes: list[int] | None = None):
    """Yields the nodes (as ``_NODES``) of each tree at the root, at the others nothing. ``bins``: features by rows; ``sizes``: each feature's number of bins, the same in all tasks."""
    width, n, depth, first = len(bins), len(label), params["maxDepth"], peers.up is None
    wide = min(width, math.ceil(float(params.get("featureSubsetStrategy", "1.0")) * width))
    share, size, sizes = params.get("subsamplingRate", 1.0), 1 << (depth + 1), sizes or [BINS] * width
    # Rows of label 0 come first, so both labels are counted by parts of one array.
    order = np.argsort(label, kind="stable")
    bins, label, key = np.ascontiguousarray(bins[:, order]), label[order], key[order]
    zeros, flat, every = int(np.searchsorted(label, 1)), bins.reshape(-1), np.arange(n)
    groups = grouped(sizes)
    codes = [np.ravel_multi_index([bins[f].astype(np.uint16) for f in g], [sizes[f] for f in g]).astype(np.uint16) for g in groups]
    sign, weight, margin = 2.0 * label - 1, np.where(label == 1, ratio, 1.0), np.zeros(n)
    for tree in range(params["maxIter"]):
        target = sign if tree == 0 else 4 * sign / (1 + np.exp(np.minimum(2 * sign * margin, 500)))
        drawn = np.flatnonzero(mixed(key, seed + tree) < np.uint64(min(share * 2.0**64, 2.0**64 - 2048))) if share < 1 else every
        units, node = np.rint(target * weight * UNIT), np.ones(n, np.int32)
        # By node: feature (-1: leaf), bin, slot of the histogram to count (-1: none).
        plan = np.full((3, size), -1, np.int64)
        plan[2, 1] = 0
        feature, value, sums, held = np.full(size, -1), np.zeros(size), np.zeros((size, 3)), {}
        cut, gains = np.zeros(size, np.int64), np.zeros(size)
        for level in range(depth):
            slots = int(plan[2].max()) + 1
            slot = plan[2][node[drawn]]
            chosen = np.flatnonzero(slot >= 0) if level else slice(None)
            rows, base = drawn[chosen], slot[chosen] * CELLS
            part, split = units[rows], int(np.searchsorted(rows, zeros))
            hist = np.zeros((slots, width, BINS, 3))
            for g, code in zip(groups, codes, strict=True):
                at, of = base + code[rows], [sizes[f] for f in g]
                for k, cells in enumerate((np.bincount(at[:split], minlength=slots * CELLS), np.bincount(at[split:], minlength=slots * CELLS), np.bincount(at, part, slots * CELLS))):
                    cells = cells.reshape(slots, CELLS)[:, : math.prod(of)].reshape(slots, *of)
                    for i, f in enumerate(g):
                        hist[:, f, : sizes[f], k] = cells.sum(tuple(j + 1 for j in range(len(g)) if j != i))
            hist = peers.summed(hist)
            counted, plan = plan[2], np.full((3, size), -1, np.int64)
            if first:
                for k in np.flatnonzero(counted >= 0).tolist():
                    held[k] = hist[counted[k]]
                    if k > 1:
                        held[k ^ 1] = held[k >> 1] - held[k]
                live = [k for k in held if k >> level == 1]
                if not level:
                    sums[1] = held[1][0].sum(0)
                rng = [np.random.default_rng([seed & 0xFFFFFFFF, tree, k]) for k in live]
                allowed = np.zeros((len(live), width), bool)
                for row, r in zip(allowed, rng, strict=True):
                    row[r.permutation(width)[:wide]] = True
                f, b, gain, low = best_splits(np.stack([held[k] for k in live]), ratio, params.get("minInstancesPerNode", 1), allowed)
                new, taken = {}, 0
                for i, k in enumerate(live):
                    if f[i] < 0:
                        continue
                    plan[0, k], plan[1, k], feature[k], cut[k], gains[k] = f[i], b[i], f[i], b[i], gain[i]
                    sums[2 * k], sums[2 * k + 1] = low[i], sums[k] - low[i]
                    new[k] = held[k]
                    plan[2, 2 * k + (sums[2 * k, :2].sum() > sums[2 * k + 1, :2].sum())] = taken
                    taken += 1
                held = new
            plan = peers.told(plan)
            if (plan[0] < 0).all():
                break
            # Rows of a leaf stay: no bin lies above its limit.
            inner, own = plan[0] >= 0, np.arange(size)
            start, limit, down = np.where(inner, plan[0] * n, 0), np.where(inner, plan[1], 255).astype(np.uint8), np.where(inner, 2 * own, own).astype(np.int32)
            node = down[node] + (flat[start[node] + every] > limit[node])
        if first:
            total = sums[:, 0] + ratio * sums[:, 1]
            value = np.where(total > 0, sums[:, 2] / np.where(total > 0, total, 1) / UNIT, 0.0)
        value = peers.told(value)
        margin += (1.0 if tree == 0 else params["stepSize"]) * value[node]
        if first:
            there = [k for k in range(1, size) if k == 1 or feature[k >> 1] >= 0]
            yield [np.full(len(there), tree), there, feature[there], cut[there], gains[there], value[there], total[there], sums[there, :2].sum(1).astype(np.int64)]


def _rows(features: DataFrame, names: list[str], cuts: list[np.ndarray], parts: int) -> DataFrame:
    """key, label, bins (a byte each) in ``parts`` partitions."""
    def run(batches):
        for b in batches:
            columns = [b.column(names.index(c) + 2).to_numpy(zero_copy_only=False) for c in names]
            packed = np.stack([np.searchsorted(t, c, "left") for t, c in zip(cuts, columns, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], names=["key", "label", "bins"])

    return _keyed(features, names).mapInArrow(run, "key long, label int, bins binary").repartition(parts, "key")


def _keyed(features: DataFrame, names: list[str]) -> DataFrame:
    """A null or a value that is no number fails here, as in Spark ML."""
    value = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit(f"{c} has a value that is no number"))).otherwise(F.col(c).cast("double")).alias(c)
    return features.select(F.xxhash64(*sorted(features.columns)).alias("key"), F.col("label").cast("int").alias("label"), *[value(c) for c in names])


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, as a barrier stage needs; 0 where that may change."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    return spark.sparkContext._jsc.sc().maxNumConcurrentTasks(spark.sparkContext._jsc.sc().resourceProfileManager().defaultResourceProfile())


def tasks(spark: SparkSession, rows: int, params: dict) -> int:
    """Tasks to train ``rows`` rows in; 0: not here."""
    parts = slots(spark)
    return min(parts, 1 + rows // 10_000) if 0 < rows <= HELD * parts and params.keys() <= KNOWN else 0


def fit(features: DataFrame, names: list[str], ratio: float, rows: int, params: dict, seed: int, parts: int) -> GBTClassificationModel:
    """``features``: the columns ``names`` and ``label`` (0 or 1), of ``rows`` rows; a row of label 1 weighs ``ratio``. At least one row."""
    spark, width, token = features.sparkSession, len(names), secrets.token_bytes(32)
    share = min(1.0, PLACED / rows)
    sampled = _keyed(features, names).where(F.pmod("key", F.lit(1 << 20)) < math.ceil(share * (1 << 20))).drop("label").toArrow()
    cuts = [cuts_of(sampled[c].to_numpy()) for c in names]

    def run(batches):
        from pyspark import BarrierTaskContext

        peers = Peers(BarrierTaskContext.get(), token)
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, width)) for b in batches if b.num_rows]
        key, label, bins = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty((0, width), np.uint8))
        held.clear()
        for columns in grown(np.ascontiguousarray(bins.T), label, key, peers, ratio, params, seed, [len(c) + 1 for c in cuts]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)
        peers.close()

    schema = "tree int, node int, feature int, bin int, gain double, value double, weight double, count long"
    found = _rows(features, names, cuts, parts).mapInArrow(run, schema, barrier=True).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    return as_spark(spark, found, cuts, params, seed)


def as_spark(spark: SparkSession, found: pa.Table, cuts: list[np.ndarray], params: dict, seed: int) -> GBTClassificationModel:
    """Spark ML's model of trees given by their nodes, through its stored form. Impurities are not known and stand as zero."""
    path, rows, trees = f"{shared_path(spark)}/{secrets.token_hex(8)}", [], params["maxIter"]
    by_tree: dict[int, list[dict]] = {}
    for r in found.to_pylist():
        by_tree.setdefault(r["tree"], []).append(r)
    for tree, nodes in by_tree.items():
        inner, ids = {r["node"]: r for r in nodes}, {}

        def number(k: int) -> None:
            ids[k] = len(ids)
            if inner[k]["feature"] >= 0:  # noqa: B023
                number(2 * k), number(2 * k + 1)

        number(1)
        for k, i in ids.items():
            r, total = inner[k], inner[k]["weight"] * inner[k]["value"]
            split, sides, gain = ((r["feature"], [float(cuts[r["feature"]][r["bin"]])], -1), (ids[2 * k], ids[2 * k + 1]), r["gain"]) if r["feature"] >= 0 else ((-1, [], -1), (-1, -1), -1.0)
            rows.append((tree, (i, r["value"], 0.0, [r["weight"], total, total * r["value"]], r["count"], gain, *sides, split)))
    own = {k: v for k, v in params.items() if k in ("maxDepth", "minInstancesPerNode")} | {"seed": seed, "impurity": "variance"}
    meta = lambda kind, uid, params, **more: json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": {}} | more)
    whole = meta("classification.GBTClassificationModel", f"GBTClassifier_{secrets.token_hex(6)}", params | {"seed": seed, "impurity": "variance", "weightCol": "weight"}, numFeatures=len(cuts), numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(k, meta("regression.DecisionTreeRegressionModel", f"dtr_{secrets.token_hex(6)}", own), 1.0 if k == 0 else float(params["stepSize"])) for k in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(rows, f"treeID int, nodeData {_NODE}", verifySchema=False).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)

"""Boosted trees for whole distributions: natural gradients of two parameters, or check losses at several levels.

A round grows one tree for each parameter (or level), all trees at once. Where the
features have few combinations of bins (`CELLS` at most), training keeps one written
table of each row's combination and target: parameters are a function of the
combination, and one aggregation of counts and gradient sums by it gives the
histograms of all tree levels. Else the table holds bin numbers, the target and the
current parameters, and each tree level takes one aggregation by (tree, node, feature,
bin); trees grown since the parameters were last written are replayed in the same pass,
and every `keep` rounds the table is written anew, which ends its lineage. Tasks add up
in numpy, so that what is shuffled and what the driver gets is of the size of the sums
whatever the number of rows.

A leaf of a distribution's tree is the mean natural gradient of its rows. A leaf of a
check-loss tree is the exact quantile of its rows' residuals, found digit by digit: four
passes count 16 bits each of the values that still agree with it. Missing features have a
bin of their own, below all others. Rows without a target are left out of training.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.scratch import written

#: Normal quantiles come from the distribution function; its table has this step.
_STEP, _TOP = 1 / 512, 6.0
ROOT_PI = math.sqrt(math.pi)

#: Combinations of bins that a table of all of them may have.
CELLS = 4096


@lru_cache(maxsize=1)
def _erf_table() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(int(_TOP / _STEP) + 2) * _STEP
    return np.array([math.erf(v) for v in x]), 2 / ROOT_PI * np.exp(-x * x) * _STEP


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by cubic interpolation of a table, to about 1e-12."""
    value, slope = _erf_table()
    a = np.minimum(np.abs(x), _TOP) / _STEP
    i = a.astype(np.int64)
    t = a - i
    u = 1 - t
    out = value[i] * (1 + 2 * t) * u * u + value[i + 1] * t * t * (3 - 2 * t) + slope[i] * t * u * u - slope[i + 1] * t * t * u
    return np.where(x < 0, -out, out)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def normal_density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


class NormalScore:
    """Parameters (location, log scale) of a normal distribution; gradients of the CRPS over its own metric,
    diag(1 / (scale sqrt(pi)), scale / (2 sqrt(pi)))."""

    trees, names = 2, ("location", "log_scale")

    def start(self, rows: DataFrame, y: str) -> list[float]:
        r = rows.agg(F.avg(y), F.stddev_pop(y)).first()
        return [r[0], math.log(r[1] or 1e-9)]

    def gradient(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        scale = np.exp(p[:, 1])
        z = (y - p[:, 0]) / scale
        return np.column_stack([ROOT_PI * scale * (1 - 2 * normal_cdf(z)), 2 * ROOT_PI * (2 * normal_density(z) - 1 / ROOT_PI)])

    def crps(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        scale = np.exp(p[:, 1])
        z = (y - p[:, 0]) / scale
        return scale * (z * (2 * normal_cdf(z) - 1) + 2 * normal_density(z) - 1 / ROOT_PI)


class LaplaceScore:
    """Parameters (location, log scale) of a Laplace distribution; gradients of the log likelihood over its
    Fisher information, diag(1 / scale^2, 1)."""

    trees, names = 2, ("location", "log_scale")

    def start(self, rows: DataFrame, y: str) -> list[float]:
        mid = exact_quantiles(rows.select(F.lit(1).alias("g"), y), ["g"], y, [0.5]).first().q[0]
        return [mid, math.log(rows.agg(F.avg(F.abs(F.col(y) - mid))).first()[0] or 1e-9)]

    def gradient(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        scale, off = np.exp(p[:, 1]), y - p[:, 0]
        return np.column_stack([-scale * np.sign(off), 1 - np.abs(off) / scale])

    def crps(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        scale = np.exp(p[:, 1])
        z = np.abs(y - p[:, 0]) / scale
        return scale * (z + np.exp(-z) - 0.75)


class CheckLoss:
    """One quantile for each level; trees are grown on the sign of the residual less its level."""

    def __init__(self, levels: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)):
        self.levels, self.trees, self.names = tuple(levels), len(levels), tuple(f"q{round(100 * p):02d}" for p in levels)

    def start(self, rows: DataFrame, y: str) -> list[float]:
        return list(exact_quantiles(rows.select(F.lit(1).alias("g"), y), ["g"], y, list(self.levels)).first().q)

    def gradient(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.where(y[:, None] > p, np.array([-q for q in self.levels]), np.array([1 - q for q in self.levels]))


@dataclass
class Tree:
    """A tree in heap order: node k has children 2k and 2k + 1; feature -1 sends all rows left. `leaf` is added to the parameter."""

    depth: int
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> "Tree":
        return cls(depth, np.full(1 << depth, -1, np.int64), np.zeros(1 << depth, np.int64), np.zeros(1 << depth))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at a depth, from 1 at the root."""
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[node]
            node = 2 * node + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > self.bin[node]))
        return node

    def added(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(bins, self.depth) - (1 << self.depth)]


@dataclass
class Boosted:
    """A fitted model: names of the parameters, edges of the bins, parameters to start from, and a list of trees for each round."""

    features: list[str]
    edges: list[list[float]]
    names: tuple[str, ...]
    start: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """0 for missing, else 1 + the number of edges below the value."""
        out = np.zeros(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(np.array(e), x[:, j], "left"))
        return out

    def parameters(self, bins: np.ndarray, p: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        p = np.tile(np.array(self.start, np.float64), (len(bins), 1)) if p is None else p.copy()
        for trees in self.rounds[first:]:
            for j, t in enumerate(trees):
                p[:, j] += t.added(bins)
        return p

    def cells(self) -> np.ndarray | None:
        """The bins of every combination, in the order of `codes`; None for more than CELLS of them."""
        widths = [len(e) + 2 for e in self.edges]
        return np.indices(widths).reshape(len(widths), -1).T if 0 < math.prod(widths) <= CELLS and widths else None

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """The number of each row's combination of bins."""
        out = np.zeros(len(bins), np.int64)
        for j, e in enumerate(self.edges):
            out = out * (len(e) + 2) + bins[:, j]
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """df with a column for each parameter; quantiles are put in order."""
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"{n} double" for n in self.names]])
        value, ordered = df.sparkSession.sparkContext.broadcast(self), self.names[0].startswith("q")
        places = [df.columns.index(f) for f in self.features]

        def run(batches):
            m = value.value
            cells = m.cells()
            known = None if cells is None else m.parameters(cells)
            for batch in batches:
                bins = m.bins(_matrix([batch.column(i) for i in places]))
                p = m.parameters(bins) if known is None else known[m.codes(bins)]
                p = np.sort(p, axis=1) if ordered else p
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, j]) for j in range(p.shape[1])]], names=[*batch.schema.names, *value.value.names])

        return df.mapInArrow(run, schema)

    def splits(self) -> list[dict]:
        """Every node and leaf as a plain row: round, parameter, node, feature, threshold (goes left up to it; null: missing only), added."""
        out = []
        for r, trees in enumerate(self.rounds):
            for name, t in zip(self.names, trees):
                for node in range(1, 2 << t.depth):
                    inner = node < 1 << t.depth
                    f = int(t.feature[node]) if inner else -1
                    edge = self.edges[f][int(t.bin[node]) - 1] if f >= 0 and t.bin[node] > 0 else None
                    out.append({"round": r, "parameter": name, "node": node, "feature": self.features[f] if f >= 0 else None, "threshold": edge, "added": None if inner else float(t.leaf[node - (1 << t.depth)])})
        return out

    def to_json(self) -> str:
        trees = [[[t.depth, t.feature.tolist(), t.bin.tolist(), t.leaf.tolist()] for t in r] for r in self.rounds]
        return json.dumps({"features": self.features, "edges": self.edges, "names": self.names, "start": self.start, "rounds": trees})

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        d = json.loads(text)
        rounds = [[Tree(n, np.array(f, np.int64), np.array(b, np.int64), np.array(v, np.float64)) for n, f, b, v in r] for r in d["rounds"]]
        return cls(d["features"], d["edges"], tuple(d["names"]), d["start"], rounds)


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]) if columns else np.zeros((0, 0))


def bin_edges(rows: DataFrame, features: list[str], bins: int = 64) -> list[list[float]]:
    """Edges between bins of about equal numbers of rows, from mergeable sketches."""
    levels = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), levels, 50 * bins).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(e or [])) for e in got]


def _read(batch: pa.RecordBatch, model: Boosted, trees: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, target, parameters after all rounds so far) of a batch of the training table."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
    p = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, trees)
    return bins, batch.column(1).to_numpy(), model.parameters(bins, p, first)


_STATE = "bins binary, y double, p binary"


def _state_batch(bins: np.ndarray, y: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    return pa.RecordBatch.from_arrays([pack(bins.astype(np.uint8)), pa.array(y), pack(np.ascontiguousarray(p))], names=["bins", "y", "p"])


def _histograms(state: DataFrame, model: Boosted, loss, grown: list[Tree], level: int, first: int) -> np.ndarray:
    """counts and gradient sums by (tree, node of the level, feature, bin): an array of shape (trees, nodes, features, bins, 2)."""
    k, width = len(model.features), max(map(len, model.edges)) + 2
    shape = (loss.trees, 1 << level, k, width)
    value = state.sparkSession.sparkContext.broadcast((model, loss, grown))

    def run(batches):
        m, score, trees = value.value
        total = np.zeros((*shape, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, p = _read(batch, m, score.trees, first)
            g = score.gradient(y, p)
            for j, t in enumerate(trees):
                node = t.nodes(bins, level) - (1 << level)
                for f in range(k):
                    at = (node * k + f) * width + bins[:, f]
                    size = shape[1] * k * width
                    total[j, ..., 0] += np.bincount(at, minlength=size).reshape(shape[1:])
                    total[j, ..., 1] += np.bincount(at, weights=g[:, j], minlength=size).reshape(shape[1:])
        flat = total.reshape(-1, 2)
        some = np.flatnonzero(flat[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some, 0]), pa.array(flat[some, 1])], names=["i", "n", "g"])

    got = state.mapInArrow(run, "i bigint, n double, g double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()
    out = np.zeros((math.prod(shape), 2))
    out[got["i"].to_numpy()] = np.column_stack([got["n"].to_numpy(), got["g"].to_numpy()])
    return out.reshape(*shape, 2)


def best_split(h: np.ndarray, least: int) -> tuple[int, int] | None:
    """(feature, last bin of the left side) of the largest fall in squares, of a node's sums (features, bins, 2).

    Sides have at least `least` rows; of equal falls (to nine digits) the first feature and bin."""
    left = np.cumsum(h, axis=1)[:, :-1]
    total = h[0].sum(0)
    right = total - left
    ok = (left[..., 0] >= least) & (right[..., 0] >= least)
    if not ok.any():
        return None
    n = np.maximum(np.stack([left[..., 0], right[..., 0]]), 1)
    gain = np.where(ok, left[..., 1] ** 2 / n[0] + right[..., 1] ** 2 / n[1] - total[1] ** 2 / max(total[0], 1), -np.inf)
    top = gain.max()
    if top <= 1e-12 * max(1.0, total[1] ** 2):
        return None
    f, b = np.unravel_index(int(np.flatnonzero((gain >= top - 1e-9 * abs(top)).ravel())[0]), gain.shape)
    return int(f), int(b)


def _cell_sums(state: DataFrame, model: Boosted, loss) -> np.ndarray:
    """The count and the gradient sum of each tree, by combination of bins: an array of shape (combinations, 1 + trees)."""
    value = state.sparkSession.sparkContext.broadcast((model, loss))

    def run(batches):
        m, score = value.value
        known = m.parameters(m.cells())
        total = np.zeros((score.trees + 1, len(known)))
        for batch in batches:
            if batch.num_rows:
                code, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                g = score.gradient(y, known[code])
                total[0] += np.bincount(code, minlength=len(known))
                for j in range(score.trees):
                    total[j + 1] += np.bincount(code, weights=g[:, j], minlength=len(known))
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(t[some]) for t in total]], names=["i", *[f"s{j}" for j in range(len(total))]])

    sums = [f"s{j}" for j in range(loss.trees + 1)]
    got = state.mapInArrow(run, ", ".join(["i bigint", *[f"{c} double" for c in sums]])).groupBy("i").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
    out = np.zeros((len(model.cells()), len(sums)))
    out[got["i"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in sums])
    return out


def _cell_histograms(sums: np.ndarray, model: Boosted, grown: list[Tree], level: int) -> np.ndarray:
    """What `_histograms` gives, from sums by combination of bins."""
    cells, k, width = model.cells(), len(model.features), max(map(len, model.edges)) + 2
    out = np.zeros((len(grown), 1 << level, k, width, 2))
    for j, t in enumerate(grown):
        node = t.nodes(cells, level) - (1 << level)
        for f in range(k):
            np.add.at(out[j, :, f], (node, cells[:, f]), sums[:, [0, j + 1]])
    return out


def _grow(state: DataFrame, model: Boosted, loss, depth: int, least: int, rate: float, first: int) -> list[Tree]:
    """One tree for each parameter; leaves are -rate x the mean gradient of their rows."""
    grown = [Tree.blank(depth) for _ in range(loss.trees)]
    sums = None if model.cells() is None else _cell_sums(state, model, loss)
    for level in range(depth):
        h = _histograms(state, model, loss, grown, level, first) if sums is None else _cell_histograms(sums, model, grown, level)
        for j, t in enumerate(grown):
            for i in range(1 << level):
                node, at = (1 << level) + i, h[j, i]
                found = best_split(at, least)
                if found:
                    t.feature[node], t.bin[node] = found
                if level == depth - 1:
                    whole = at[0].sum(0)
                    left = at[found[0], : found[1] + 1].sum(0) if found else whole
                    for side, (n, g) in enumerate((left, whole - left)):
                        t.leaf[2 * i + side] = -rate * g / n if n > 0 else 0.0
    return grown


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """64 bits that compare as the numbers do."""
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _from_ordered_bits(bits: int) -> float:
    bits = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digits(state: DataFrame, model: Boosted, loss, grown: list[Tree], first: int, groups: list[tuple[int, int, int]], done: int, step: int) -> np.ndarray:
    """counts by group and next digit of the residuals in each group: (tree, leaf, the first `done` bits)."""
    value = state.sparkSession.sparkContext.broadcast((model, loss, grown, groups))
    size = len(groups) << step

    def run(batches):
        m, score, trees, asked = value.value
        cells = m.cells()
        if cells is not None:
            known, place = m.parameters(cells), [t.nodes(cells, t.depth) - (1 << t.depth) for t in trees]
        # the groups of a tree's leaf: one before the first digit, later up to two
        slots = [[] for _ in trees]
        for j, t in enumerate(trees):
            for turn in range(2):
                of, prefix = np.full(1 << t.depth, -1, np.int64), np.zeros(1 << t.depth, np.uint64)
                for leaf in range(1 << t.depth):
                    mine = [i for i, (a, b, _) in enumerate(asked) if (a, b) == (j, leaf)]
                    if turn < len(mine):
                        of[leaf], prefix[leaf] = mine[turn], asked[mine[turn]][2]
                if (of >= 0).any():
                    slots[j].append((of, prefix))
        total = np.zeros(size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if cells is None:
                bins, y, p = _read(batch, m, score.trees, first)
            else:
                code, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for j, t in enumerate(trees):
                if not slots[j]:
                    continue
                leaf = t.nodes(bins, t.depth) - (1 << t.depth) if cells is None else place[j][code]
                bits = _ordered_bits(y - (p[:, j] if cells is None else known[code, j]))
                for of, prefix in slots[j]:
                    g, b = of[leaf], bits
                    if done:
                        keep = np.flatnonzero((g >= 0) & (bits >> np.uint64(64 - done) == prefix[leaf]))
                        g, b = g[keep], bits[keep]
                    at = (g << step) + ((b >> np.uint64(64 - done - step)) & np.uint64((1 << step) - 1)).astype(np.int64)
                    np.add.at(total, at, 1)  # not bincount, which would cost the whole table a batch
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    got = state.mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(len(groups), -1)


def _quantile_leaves(state: DataFrame, model: Boosted, loss: CheckLoss, grown: list[Tree], rate: float, first: int) -> None:
    """Set the leaves of check-loss trees to rate x the exact quantile (linear interpolation) of their rows' residuals."""
    leaves = [(j, leaf) for j, t in enumerate(grown) for leaf in range(1 << t.depth)]
    step = 16 if len(leaves) <= 128 else 8
    wanted: dict[tuple[int, int, int], list[int]] = {}  # (tree, leaf, which of the two ranks): [rank, bits so far]
    part: dict[tuple[int, int], float] = {}
    for done in range(0, 64, step):
        groups = sorted({(j, leaf, bits) for (j, leaf, _), (_, bits) in wanted.items()}) if done else [(j, leaf, 0) for j, leaf in leaves]
        counts = _digits(state, model, loss, grown, first, groups, done, step)
        if not done:
            for (j, leaf), n in zip(leaves, counts.sum(1)):
                if n:
                    at = (int(n) - 1) * loss.levels[j]
                    low = math.floor(at)
                    part[j, leaf] = at - low
                    wanted |= {(j, leaf, 0): [low, 0], (j, leaf, 1): [min(low + 1, int(n) - 1), 0]}
        upto = dict(zip(groups, np.cumsum(counts, axis=1)))
        for (j, leaf, _), w in wanted.items():
            c = upto[j, leaf, w[1]]
            digit = int(np.searchsorted(c, w[0], "right"))
            w[:] = [w[0] - (int(c[digit - 1]) if digit else 0), (w[1] << step) + digit]
    for j, leaf in leaves:
        if (j, leaf) in part:
            x, y = (_from_ordered_bits(wanted[j, leaf, side][1]) for side in (0, 1))
            grown[j].leaf[leaf] = rate * (x + (y - x) * part[j, leaf])


def fit(train: DataFrame, features: list[str], y: str, loss, rounds: int = 100, depth: int = 2, rate: float = 0.1, least: int = 20, bins: int = 64, edges: list[list[float]] | None = None, keep: int = 10) -> Boosted:
    """Boosted trees of a loss (NormalScore, LaplaceScore or CheckLoss); at most 254 edges a feature."""
    rows = train.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias(y))
    edges = edges or bin_edges(rows, features, bins)
    if max(map(len, edges), default=0) > 254:
        raise ValueError("a bin number takes one byte: at most 254 edges")
    if not rows.limit(1).count():
        raise ValueError("no row with a target")
    model = Boosted(features, edges, loss.names, [float(v) for v in loss.start(rows, y)])
    value = rows.sparkSession.sparkContext.broadcast(model)

    whole = model.cells() is not None

    def enter(batches):
        for batch in batches:
            b, target = value.value.bins(_matrix(batch.columns[:-1])), batch.column(len(features)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(value.value.codes(b).astype(np.int32)), pa.array(target)], names=["code", "y"]) if whole else _state_batch(b, target, value.value.parameters(b))

    state, first = written(rows.mapInArrow(enter, "code int, y double" if whole else _STATE), "boosting"), 0
    for r in range(rounds):
        grown = _grow(state, model, loss, depth, least, rate, first)
        if isinstance(loss, CheckLoss):
            _quantile_leaves(state, model, loss, grown, rate, first)
        model.rounds.append(grown)
        if not whole and r + 1 - first >= keep and r + 1 < rounds:
            state, first = written(_advanced(state, model, loss.trees, first), "boosting"), r + 1
    return model


def _advanced(state: DataFrame, model: Boosted, trees: int, first: int) -> DataFrame:
    value = state.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _state_batch(*_read(batch, value.value, trees, first))

    return state.mapInArrow(run, _STATE)

"""Gradient boosting of trees for counts: Poisson loss with a log link, on histograms of binned features.

Each level of a tree is one pass: tasks add up gradients, hessians and rows by node, feature and
bin, one aggregation adds the tasks' sums, and the driver looks for the splits in them; these
have (nodes x features x bins) cells, whatever the rows. Gradients are whole numbers of a power
of two, so sums don't depend on their order and a model is the same on any partitioning. Equal
rows are one row with their number, which changes no sum. Scores of rows are stored every SAVE
trees; between, tasks add the trees since then.

Trees grow level by level to at most max_leaves leaves, the best splits of a level first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import passes
from panelforge.operators.quantiles import quantiles
from panelforge.sources.tables import stored

SAVE, BLOCK = 10, 1 << 15
MIN_HESSIAN = 1e-3


@dataclass
class Tree:
    """Nodes as a heap: feature (-1 in leaves), the last bin that goes left, and the leaf's value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            right = bins[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def score(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class Model:
    names: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, matrix: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, matrix[:, i], "left") for i, e in enumerate(self.edges)], 1).astype(np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += t.score(bins)
        return out


def bin_edges(df: DataFrame, names: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: its distinct exact quantiles. The largest value has no upper end."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("v")) for i, n in enumerate(names)])).alias("x")).select("x.*")
    found = quantiles(long, "v", ["f"], [i / bins for i in range(1, bins)]).select("f", "value").distinct().collect()  # features x bins at most
    tops = {r.f: r.v for r in long.groupBy("f").agg(F.max("v").alias("v")).collect()}
    return [np.array(sorted(r.value for r in found if r.f == i and r.value < tops[i])) for i in range(len(names))]


def best_splits(sums: np.ndarray, scale: float, least: int) -> list[tuple[float, int, int, tuple, tuple] | None]:
    """For each node, of sums (node, feature, bin, (g, h, n)): gain, feature, last bin of the left side, and both sides' (g, h)."""
    g, h = sums[..., 0] / scale, sums[..., 1] / scale
    left = [np.cumsum(sums[..., i], 2) for i in range(3)]
    gl, hl, nl = left[0] / scale, left[1] / scale, left[2]
    whole_g, whole_h, whole_n = (x[:, :1].sum(2)[:, :, None] for x in (g, h, sums[..., 2]))
    gr, hr, nr = whole_g - gl, whole_h - hl, whole_n - nl
    ok = (nl >= least) & (nr >= least) & (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl**2 / hl + gr**2 / hr - whole_g**2 / whole_h, 0.0)
    out = []
    for node in range(len(sums)):
        at = int(np.argmax(gain[node]))
        f, b = divmod(at, gain.shape[2])
        best = float(gain[node, f, b])
        out.append((best, f, b, (gl[node, f, b], hl[node, f, b]), (gr[node, f, b], hr[node, f, b])) if best > 0 else None)
    return out


def _grown(level_sums, scale: float, depth: int, max_leaves: int, least: int, rate: float) -> Tree:
    """A tree from level_sums(tree, nodes), the sums of nodes of a level."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), depth)
    nodes, leaves = [0], 1
    for _ in range(depth):
        sums = level_sums(tree, nodes)
        found = best_splits(sums, scale, least)
        if nodes == [0]:
            g, h = (sums[0, 0, :, i].sum() / scale for i in (0, 1))
            tree.value[0] = -rate * g / h
        next_ = []
        for i in sorted((i for i, s in enumerate(found) if s), key=lambda i: -found[i][0]):
            if leaves == max_leaves:
                break
            _, f, b, *sides = found[i]
            node = nodes[i]
            tree.feature[node], tree.cut[node] = f, b
            for child, (g, h) in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                tree.value[child] = -rate * g / h
                next_.append(child)
            leaves += 1
        nodes = sorted(next_)
        if not nodes:
            break
    return tree


def whole_sums(cell: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by cell. bincount adds doubles, so large ones go in two parts that stay exact."""
    if len(values) and float(np.abs(values).max()) * len(values) >= 2.0**53:
        high = values >> 26
        return (whole_sums(cell, high, size) << 26) + whole_sums(cell, values - (high << 26), size)
    return np.bincount(cell, values, size).astype(np.int64)


def histograms(tree: Tree, nodes: Sequence[int], bins: np.ndarray, y: np.ndarray, raw: np.ndarray, scale: float, width: int, times: np.ndarray | None = None) -> np.ndarray:
    """Whole-number sums (node, feature, bin, (g, h, n)) of some rows, each of which stands for times rows."""
    place = np.full(len(tree.feature), -1)
    place[list(nodes)] = np.arange(len(nodes))
    at = place[tree.leaves(bins)]
    here = at >= 0
    at, bins, mean = at[here], bins[here], np.exp(raw[here])
    n = np.ones(len(at), np.int64) if times is None else times[here].astype(np.int64)
    parts = [np.rint((mean - y[here]) * scale).astype(np.int64) * n, np.rint(mean * scale).astype(np.int64) * n, n]
    out = np.zeros((len(nodes), bins.shape[1], width, 3), np.int64)
    for f in range(bins.shape[1]):
        cell = at * width + bins[:, f]
        for i, w in enumerate(parts):
            out[:, f, :, i] = whole_sums(cell, w, len(nodes) * width).reshape(len(nodes), width)
    return out


def scale_of(rows: int, total: float, most: float) -> float:
    """The power of two by which gradients become whole numbers: sums of a block stay exact as doubles, those of all rows fit in 64 bits."""
    return float(2.0 ** np.floor(min(np.log2(2.0**53 / (BLOCK * 32 * (most + 1))), np.log2(2.0**60 / (8 * (total + rows))))))


def fit(train: DataFrame, names: Sequence[str], y: str, rounds: int = 100, rate: float = 0.1, bins: int = 255, depth: int = 5, max_leaves: int = 31, least: int = 20) -> Model:
    """Null features count as 0. Rows without a target are left out; targets are not negative."""
    rows = train.where(F.col(y).isNotNull())
    n, total, most = rows.agg(F.count(F.lit(1)), F.sum(F.col(y).cast("double")), F.max(F.col(y).cast("double"))).first()
    if not total:
        raise ValueError("a Poisson model needs some event in its rows")
    model = Model(list(names), bin_edges(rows, names, bins), float(np.log(total / n)))
    scale, width, k = scale_of(n, total, most), max(len(e) for e in model.edges) + 1, len(names)
    matrix = passes.packed(passes.alike(rows, [*names, y]), [*names, y, passes.TIMES], BLOCK)

    def prepared(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column(0).to_pylist():
                m = np.frombuffer(data).reshape(-1, k + 2)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (model.binned(m).tobytes(), m[:, k].tobytes(), m[:, k + 1].tobytes(), np.full(len(m), model.base).tobytes())], names=names_)

    names_ = ["bins", "y", "times", "raw"]
    kinds = ", ".join(f"{c} binary" for c in names_)
    blocks = stored(matrix.mapInArrow(prepared, kinds), "binned")
    fresh: list[Tree] = []

    def scored(bins: bytes, raw: bytes, trees: Sequence[Tree]) -> tuple[np.ndarray, np.ndarray]:
        b, r = np.frombuffer(bins, np.uint8).reshape(-1, k), np.frombuffer(raw).copy()
        for t in trees:
            r += t.score(b)
        return b, r

    def level_sums(tree: Tree, nodes: list[int]) -> np.ndarray:
        trees = list(fresh)

        def one(bins: bytes, y: bytes, times: bytes, raw: bytes) -> np.ndarray:
            b, r = scored(bins, raw, trees)
            return histograms(tree, nodes, b, np.frombuffer(y), r, scale, width, np.frombuffer(times))

        return passes.totals(blocks, (len(nodes), k, width, 3), np.int64, one)

    for i in range(rounds):
        tree = _grown(level_sums, scale, depth, max_leaves, least, rate)
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == SAVE and i + 1 < rounds:
            trees = list(fresh)

            def saved(batches, trees=trees):
                import pyarrow as pa

                for b in batches:
                    raws = [scored(x, r, trees)[1].tobytes() for x, r in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raws, pa.binary())], names=names_)

            blocks = stored(blocks.mapInArrow(saved, kinds), "binned")
            fresh.clear()
    return model


def predicted(test: DataFrame, model: Model) -> DataFrame:
    """test with pred."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names, width = model.names, len(test.columns)
    schema = StructType(test.schema.fields + StructType.fromDDL("pred double").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[width:]])
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(np.exp(model.raw(model.binned(m))))], schema=arrow)

    extra = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, n in enumerate(names)]
    return test.select("*", *extra).mapInArrow(run, schema)

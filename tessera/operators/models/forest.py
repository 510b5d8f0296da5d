"""Random forests (L3, L4) and the nested evaluation of forest candidates.

Rows are binned once (``fit_bins``: every value its own bin where a feature has at most ``max_bins`` of them,
quantile cuts otherwise) and written as a table.  All trees of all forests are grown together in two steps:

1. *Levels.*  While a node holds more than ``LOCAL_ROWS`` rows, one aggregate a level sums (node, feature,
   bin) -> rows and class weights (or weighted sums of the target) for the open nodes of all trees; the
   best cut of each node is found in the task that holds the node's cells; one row a node reaches the driver.
2. *Subtrees.*  A node with at most ``LOCAL_ROWS`` rows (``CLASS_ROWS`` for classes) goes to one task, as packed blocks of rows,
   and is finished there, level by level with numpy.  Trees whose roots are that small share the blocks and grow together.

Rows of equal bins stay together in every tree.  Where the table has at most ``LOCAL_ROWS`` different ones, one pass draws all
trees and sums each one's weights a *cell* (equal bins, fold), and a tree is grown from its cells in one task, whatever the
number of rows: no level reads the rows again.  Nested evaluation does so from ``CELL_SHARE`` rows a cell.

All steps use the same cut search.  Bootstrap weights are Poisson(1) draws from a hash of (tree, row key);
the features a node may use are drawn from a hash of (tree, path of the node, feature), skipping constant ones.
So a tree does not depend on partitions, on how many other trees there are, or on how deep it may grow, and

- the first 10 trees of a 200-tree forest are the 10-tree forest,
- a tree cut off at depth 5 is the depth-5 tree,
- a tree cut off at nodes of fewer than 10 rows is the tree with ``min_samples_split=10``.

``nested_scores`` uses that: one forest a fold scores every combination of trees, depth and split size.

A cut lies half-way between the neighbouring values of the node (of the bins' bounds, if a feature has quantile bins).
``min_samples_split`` counts the distinct rows drawn into a node.  Cuts with equal scores: the smaller
feature number, then the smaller value.  Missing features at prediction go to the right side.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.session import scratch_path, ship_package, spread

LOCAL_ROWS = 1 << 18          # rows of a node (or cells of a tree) that one task finishes
CLASS_ROWS = 1 << 20          # the same for classes, whose trees take less memory and time a row
DEALT_BYTES = 32 << 20        # blocks that a task of the deal puts out at a time
PASS_ROWS = 1 << 16           # rows that a task takes at a time in passes over the table
MAX_BINS = 256                # a bin number is one byte
CELLS_AT_ONCE = 8_000_000     # numbers of a task's histograms in one pass over the rows
BLOCK_ROWS = 1024             # test rows whose trees are added up in one task
GROWN_CELLS = 1 << 16         # cells from which a task grows its trees in one go
CELL_SHARE = 4                # rows a cell from which nested evaluation grows from cells
MAX_MODEL_BYTES = 512 << 20   # trees that a prediction broadcasts; more is an error
UNLIMITED = 1 << 14
SLACK = 1e-9                  # scores of values closer than this share of a node's sum of squares are equal


@dataclass(frozen=True)
class Spec:
    trees: int = 100
    depth: int | None = None
    min_split: int = 2
    classes: int = 0           # 0: regression
    tries: int | None = None   # features a node may use; None: all
    bootstrap: bool = True
    seed: int = 42
    shift: float = 0.0         # taken from the target before summing (its mean)
    nested: tuple[tuple[int, int, int], ...] = ()  # (trees, depth, split size) of the candidates that the trees serve

    @property
    def deepest(self) -> int:
        return UNLIMITED if self.depth is None else self.depth

    def of(self, tree: int) -> Spec:
        """How far a tree grows: as far as a candidate with so many trees asks."""
        own = [(d, s) for n, d, s in self.nested if n > tree]
        return replace(self, depth=max(d for d, _ in own), min_split=min(s for _, s in own), nested=()) if own else self


@dataclass(frozen=True)
class Bins:
    """The bins of a feature: a value's bin is the number of edges below it; ``low`` and ``high`` bound a bin's values."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def between(self, cut: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last bin of the left side, threshold) of cuts between the bins ``cut`` and ``after``, with no row of the node between them."""
        threshold = (self.high[cut] + self.low[after]) / 2
        return np.clip(np.searchsorted(self.high, threshold, side="right") - 1, cut, after - 1), threshold


# ------------------------------------------------------------------ hashed draws
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tree_seed(spec: Spec, tree: int) -> np.uint64:
    return mix(mix(np.array([spec.seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)) ^ np.uint64(tree))[0]


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1), dtype=float)) for k in range(20)])


def row_weights(spec: Spec, seed: np.uint64, hashes: np.ndarray) -> np.ndarray:
    """How often a tree draws each row: Poisson(1) by hash, or once without resampling."""
    if not spec.bootstrap:
        return np.ones(len(hashes), dtype=np.int64)
    unit = (mix(hashes.view(np.uint64) ^ mix(seed ^ np.uint64(0x5EED))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON, unit, side="right")


def child_seeds(seeds: np.ndarray) -> np.ndarray:
    """The seeds of the left and right child of each node."""
    return np.stack([mix(seeds ^ np.uint64(0x1EF7)), mix(seeds ^ np.uint64(0x21687))], axis=1)


# ------------------------------------------------------------------ statistics of rows and nodes
def row_stats(spec: Spec, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Class weights a row, or (weight, weighted target, weighted square of the target)."""
    if spec.classes:
        out = np.zeros((len(y), spec.classes))
        out[np.arange(len(y)), y.astype(int)] = w
        return out
    z = y - spec.shift
    return np.stack([w, w * z, w * z * z], axis=1).astype(np.float64)


def node_score(spec: Spec, s: np.ndarray) -> np.ndarray:
    """What a cut maximises, summed over its two sides: the weight minus the impurity (up to a constant).  ``s`` has a row a sum."""
    if spec.classes:
        return (s * s).sum(axis=0) / s.sum(axis=0)
    return s[1] ** 2 / s[0]


def is_impure(spec: Spec, s: np.ndarray) -> np.ndarray:
    if spec.classes:
        return s.max(axis=1) < s.sum(axis=1)
    return s[:, 2] * s[:, 0] - s[:, 1] ** 2 > 1e-12 * np.maximum(s[:, 2] * s[:, 0], 1e-300)


def node_values(spec: Spec, s: np.ndarray) -> np.ndarray:
    """Class probabilities, or the mean (one column)."""
    if spec.classes:
        return s / s.sum(axis=1, keepdims=True)
    return (s[:, 1] / s[:, 0] + spec.shift)[:, None]


def best_cuts(spec: Spec, node: np.ndarray, bins: np.ndarray, count: np.ndarray, stats: np.ndarray, nodes: int) -> dict[str, np.ndarray]:
    """The best cut of one feature in each node, from its cells sorted by (node, bin); ``stats`` has a row a sum, a column a cell.

    ``score`` is -inf where a node has one cell only; a row with ``bin <= cut`` goes left.
    """
    out = {"score": np.full(nodes, -np.inf), "slack": np.zeros(nodes), "cut": np.zeros(nodes, dtype=np.int64), "after": np.zeros(nodes, dtype=np.int64),
           "left_n": np.zeros(nodes, dtype=np.int64), "left": np.zeros((len(stats), nodes)).T}
    if not len(node):
        return out
    same = node[1:] == node[:-1]
    start = np.flatnonzero(np.r_[True, ~same])
    which = node[start]
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(node)]))
    total = np.add.reduceat(stats, start, axis=1)
    # Sums of values carry rounding that depends on the order; class weights are exact.
    out["slack"][which] = slack = np.zeros(len(start)) if spec.classes else SLACK * total[2]
    inner = np.flatnonzero(same)  # cuts lie after these cells
    if not len(inner):
        return out
    running = np.cumsum(stats, axis=1)
    before, group = running[:, start] - stats[:, start], group[inner]
    left = running[:, inner] - before[:, group]
    score = node_score(spec, left) + node_score(spec, total[:, group] - left)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    cuts = group[first]  # the nodes with a cut
    best = np.maximum.reduceat(score, first)
    least = np.zeros(len(start))
    least[cuts] = best - slack[cuts]
    hit = np.flatnonzero(score >= least[group])
    hit = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]
    at, which, start = inner[hit], which[cuts], start[cuts]
    running_n = np.cumsum(count)
    out["score"][which] = best
    out["cut"][which], out["left_n"][which], out["left"][which] = bins[at], running_n[at] - (running_n[start] - count[start]), left[:, hit].T
    out["after"][which] = bins[at + 1]
    return out


def feature_draw(seeds: np.ndarray, features: int) -> np.ndarray:
    return mix(seeds[:, None] ^ mix(np.arange(1, features + 1, dtype=np.uint64))[None, :]).astype(np.float64)


def allowed_features(spec: Spec, seeds: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Which features each node may use: the first ``tries`` usable ones in the order of a hash."""
    nodes, features = usable.shape
    if spec.tries is None or spec.tries >= features:
        return usable
    draw = feature_draw(seeds, features)
    draw[~usable] = np.inf
    last = np.partition(draw, spec.tries - 1, axis=1)[:, spec.tries - 1:spec.tries]
    return usable & (draw <= last)


def choose(spec: Spec, seeds: np.ndarray, found: list[dict[str, np.ndarray]], bins: list[Bins]) -> dict[str, np.ndarray]:
    """Each node's cut among its features' best ones, with its ``threshold``; ``feature`` is -1 where there is none."""
    score = np.stack([f["score"] for f in found], axis=1)
    score = np.where(allowed_features(spec, seeds, score > -np.inf), score, -np.inf)
    best = score.max(axis=1)
    slack = np.max([f["slack"] for f in found], axis=0)
    feature = (score >= np.where(best > -np.inf, best - slack, -np.inf)[:, None]).argmax(axis=1)  # the first that is as good
    rows = np.arange(len(score))
    out = {k: np.stack([f[k] for f in found], axis=1)[rows, feature] for k in ("cut", "after", "left_n", "left")}
    out["score"] = score[rows, feature]
    out["feature"] = np.where(out["score"] > -np.inf, feature, -1)
    return with_thresholds(out, bins)


def with_thresholds(out: dict[str, np.ndarray], bins: list[Bins]) -> dict[str, np.ndarray]:
    out["threshold"] = np.zeros(len(out["feature"]))
    for f, b in enumerate(bins):
        own = np.flatnonzero(out["feature"] == f)
        out["cut"][own], out["threshold"][own] = b.between(out["cut"][own], out["after"][own])
    return out


# ------------------------------------------------------------------ growing a subtree inside a task
def row_codes(x: np.ndarray) -> np.ndarray:
    """One number (or string of bytes) a binned row."""
    if x.shape[1] > 8:
        return np.ascontiguousarray(x).view(f"V{x.shape[1]}").reshape(-1)
    return (x.astype(np.uint64) << (8 * np.arange(x.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def merged(x: np.ndarray, n: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal bins as one, with their sums."""
    _, first, place = np.unique(row_codes(x), return_index=True, return_inverse=True)
    return x[first], np.bincount(place, weights=n).astype(np.int64), np.stack([np.bincount(place, weights=c) for c in stats.T], axis=1)


def cells_by_tree(spec: Spec, x: np.ndarray, y: np.ndarray, h: np.ndarray, trees: list[tuple[int, np.uint64]]):
    """(tree, cells, rows drawn, sums) of the trees (number, seed) with a drawn row; rows of equal bins are found once for all of them."""
    _, first, place = np.unique(row_codes(x), return_index=True, return_inverse=True)
    cells, x = len(first), x[first]
    classed = place * spec.classes + y.astype(np.int64) if spec.classes else None
    for t, seed in trees:
        w = row_weights(spec, seed, h)
        n = np.bincount(place[w > 0], minlength=cells)
        if spec.classes:
            stats = np.bincount(classed, weights=w, minlength=cells * spec.classes).reshape(cells, -1)
        else:
            stats = np.stack([np.bincount(place, weights=c, minlength=cells) for c in row_stats(spec, y, w).T], axis=1)
        drawn = np.flatnonzero(n)
        if len(drawn):
            yield t, x[drawn], n[drawn], stats[drawn]


def _sorted_cuts(spec: Spec, x: np.ndarray, count: np.ndarray, stats: np.ndarray, rows: np.ndarray, node: np.ndarray, feature, nodes: int) -> dict[str, np.ndarray]:
    """``best_cuts`` of rows in their nodes by one feature, or by one a row."""
    # The row in the low bits: equal keys keep the order of the rows.
    key = np.sort((node * 256 + x[rows, feature] << 32) | np.arange(len(rows)))
    own, key = rows[key & 0xFFFFFFFF], key >> 32
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key = key[at]
    return best_cuts(spec, key >> 8, key & 255, np.add.reduceat(count[own], at), np.add.reduceat(np.take(stats, own, axis=1), at, axis=1), nodes)


def _node_cuts(spec: Spec, bins: list[Bins], x: np.ndarray, count: np.ndarray, stats: np.ndarray, rows: np.ndarray, cur: np.ndarray, seeds: np.ndarray) -> dict[str, np.ndarray]:
    """The cut of each node; of its features only those are looked at that its draw may take."""
    nodes, features = len(seeds), x.shape[1]
    if spec.tries is None or spec.tries >= features:
        return choose(spec, seeds, [_sorted_cuts(spec, x, count, stats, rows, cur, f, nodes) for f in range(features)], bins)
    turn = np.argsort(feature_draw(seeds, features), axis=1)
    usable = np.zeros(nodes, dtype=np.int64)
    # With one feature a node, its cut is the node's.
    found = [best_cuts(spec, *[np.zeros(0, np.int64)] * 3, np.zeros((len(stats), 0)), nodes) for _ in range(1 if spec.tries == 1 else features)]
    feature = np.full(nodes, -1)
    for i in range(features):
        wanted = turn[:, i]
        take = (usable < spec.tries)[cur]
        own, node = (rows, cur) if take.all() else (rows[take], cur[take])
        if not len(own):
            break
        got = _sorted_cuts(spec, x, count, stats, own, node, wanted[node], nodes)
        has = got["score"] > -np.inf
        for f, into in enumerate(found):
            mine = has if spec.tries == 1 else has & (wanted == f)
            for c in got:
                into[c][mine] = got[c][mine]
        feature[has] = wanted[has]
        usable += has
    if spec.tries == 1:
        return with_thresholds({**found[0], "feature": feature}, bins)
    return choose(spec, seeds, found, bins)


def grow_cells(spec: Spec, bins: list[Bins], x: np.ndarray, count: np.ndarray, stats: np.ndarray, seed: np.uint64, depth: int = 0) -> dict[str, np.ndarray]:
    """The subtree of a node at ``depth`` from cells of ``count`` rows and their sums."""
    return grow_together(spec, bins, x, count, stats, np.zeros(len(x), dtype=np.int64), np.array([seed], dtype=np.uint64), depth)


class Packed:
    """Whole numbers of rows (class weights, then the count), several to a word, so that one sum adds all of them.

    The sums of a set of rows can be read if each is below ``1 << bits``; so can the difference of two running sums, though these overflow."""

    def __init__(self, columns: list[np.ndarray], bits: int, room: int):
        self.bits, self.per, self.width, self.mask = bits, max(1, room // bits), len(columns), np.int64((1 << bits) - 1)
        self.words = [np.zeros(len(columns[0]), dtype=np.int64) for _ in range(-(-self.width // self.per))]
        for i, c in enumerate(columns):
            self.words[i // self.per] += c.astype(np.int64) << np.int64(i % self.per * bits)

    def column(self, words: list[np.ndarray], i: int) -> np.ndarray:
        return (words[i // self.per] >> np.int64(i % self.per * self.bits)) & self.mask


SMALL_NODE = 512      # rows from which a node's sums come from counting into all bins
SMALL_BITS = 15       # of a sum of a smaller node


def _packed_cuts(packed: Packed, key: np.ndarray, run: list[np.ndarray], total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nodes with a cut, score, cut, next bin, class sums and rows of the left side) of cells sorted by ``key`` (node, bin), with
    running sums up to each cell; ``total`` has a row a class, a column a node.  The scores are those of ``node_score``."""
    classes, nodes = total.shape
    node = key >> 8
    same = node[1:] == node[:-1]
    inner = np.flatnonzero(same)  # cuts lie after these cells
    start = np.flatnonzero(~same)
    before = []
    for r in run:
        before.append(np.zeros(nodes, dtype=np.int64))
        before[-1][node[start + 1]] = r[start]
    group = node[inner]
    left = [r[inner] - b[group] for r, b in zip(run, before)]
    sums, squares, others = np.zeros(len(inner)), np.zeros(len(inner)), np.zeros(len(inner))
    for c in range(classes):
        one = packed.column(left, c).astype(np.float64)
        rest = total[c][group]
        rest -= one
        sums += one
        one *= one
        squares += one
        rest *= rest
        others += rest
    squares /= sums
    others /= np.subtract(total.sum(axis=0)[group], sums, out=sums)
    squares += others
    if not len(inner):
        return np.zeros(0, np.int64), squares, inner, inner, np.zeros((classes, 0)), inner
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    which = group[first]
    best = np.zeros(nodes)
    best[which] = most = np.maximum.reduceat(squares, first)
    hit = np.flatnonzero(squares >= best[group])
    own = group[hit]
    hit = hit[np.concatenate([[True], own[1:] != own[:-1]])]  # the first that is as good
    at, left = inner[hit], [w[hit] for w in left]
    return which, most, key[at] & 255, key[at + 1] & 255, np.stack([packed.column(left, c) for c in range(classes)]).astype(np.float64), packed.column(left, classes)


def _turns(seeds: np.ndarray, features: int):
    """The features of each node in the order of its draw, a turn at a time; few nodes need more than the first."""
    draw = feature_draw(seeds, features)
    best, at = draw[:, 0].copy(), np.zeros(len(draw), dtype=np.int64)
    for f in range(1, features):
        at[draw[:, f] < best] = f
        np.minimum(best, draw[:, f], out=best)
    yield at
    if features > 1:
        yield from np.argsort(draw, axis=1).T[1:]


def _grow_drawn(spec: Spec, bins: list[Bins], x: np.ndarray, count: np.ndarray, stats: np.ndarray, root: np.ndarray, seeds: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """``grow_together`` for classes where a node looks at one feature: large nodes count their rows into all bins, the rows of the others
    are sorted by (node, bin).  What no later level needs is worked out once for all nodes."""
    rows, features = x.shape
    flat = np.ascontiguousarray(x.T).reshape(-1)
    columns = [*stats.T, count]
    near = Packed(columns, SMALL_BITS, 62)
    far = Packed(columns, max(int(stats.sum()), int(count.sum()), 1).bit_length(), 52)
    doubles = [w.astype(np.float64) for w in far.words]
    cur, used, parts = root.astype(np.int64), 0, []
    s = np.stack([np.bincount(cur, weights=c, minlength=len(seeds)) for c in stats.T])
    n = np.bincount(cur, weights=count, minlength=len(seeds)).astype(np.int64)
    place = np.arange(len(seeds))
    own = np.arange(rows)
    while len(seeds):
        m = len(seeds)
        level = {"feature": np.full(m, -1, np.int16), "cut": np.zeros(m, np.int64), "after": np.zeros(m, np.int64), "left": np.zeros(m, np.int32), "n": n,
                 "depth": np.full(m, depth, np.int32), "gain": np.zeros(m), "sums": s}
        parts.append(level)
        used += m
        weight = s.sum(axis=0)
        live = np.flatnonzero((n >= max(spec.min_split, 2)) & (s.max(axis=0) < weight)) if depth < spec.deepest else np.zeros(0, int)
        if not len(live):
            break
        # ``cur`` is a place among the children of the level above; rows of leaves stay behind.
        to = np.full(m, -1)
        to[live] = np.arange(len(live))
        cur = np.append(to, -1)[place][cur]
        stay = np.flatnonzero(cur >= 0)
        if len(stay) < len(cur):
            own, cur = own[stay], cur[stay]
        m, total = len(live), s[:, live]
        large = (n[live] >= SMALL_NODE) | (weight[live] >= 1 << SMALL_BITS)
        feature, score, cut, after = np.full(m, -1), np.zeros(m), np.zeros(m, np.uint8), np.zeros(m, np.uint8)
        left, left_n = np.zeros((spec.classes, m)), np.zeros(m, np.int64)
        for i, wanted in enumerate(_turns(seeds[live], features)):
            if i:
                pending = feature < 0
                if not pending.any():
                    break
                take = np.flatnonzero(pending[cur])
                some, node = own[take], cur[take]
                value[take] = mine = flat[(wanted * rows)[node] + some]
            else:
                some, node = own, cur
                value = mine = flat[(wanted * rows)[cur] + own]
            wide = large & pending if i else large
            if wide.all():
                found, order = [_counted(far, doubles, some, node, mine, np.arange(m), total)], None
            elif wide.any():
                side = wide[node]
                at = np.flatnonzero(side)
                first = some[at], node[at], mine[at]
                found = [_counted(far, doubles, *first, np.flatnonzero(wide), total)]
                at = np.flatnonzero(~side)
                cuts, order = _ordered(near, some[at], node[at], mine[at], total)
                found.append(cuts)
                order = [np.concatenate(c) for c in zip(first, order)]
            else:
                cuts, order = _ordered(near, some, node, mine, total)
                found = [cuts]
            if not i and order is not None:
                own, cur, value = order  # rows of a node beside each other
            for which, *got, sides, sizes in found:
                feature[which], score[which], cut[which], after[which] = wanted[which], *got
                left[:, which], left_n[which] = sides, sizes
        ok = np.flatnonzero(feature >= 0)
        split = live[ok]
        for c, v in (("feature", feature), ("cut", cut), ("after", after)):
            level[c][split] = v[ok]
        level["left"][split] = used + 2 * np.arange(len(ok))
        level["gain"][split] = score[ok] - node_score(spec, s[:, split])
        cur = 2 * cur + (value > cut[cur])
        place = np.full((m, 2), -1)
        place[ok] = 2 * np.arange(len(ok))[:, None] + np.arange(2)
        place = place.reshape(-1)
        left, left_n = left[:, ok], left_n[ok]
        s = np.stack([left, total[:, ok] - left], axis=2).reshape(spec.classes, -1)
        n = np.stack([left_n, n[split] - left_n], axis=1).reshape(-1)
        seeds = child_seeds(seeds[split]).reshape(-1)
        depth += 1
    out = {k: np.concatenate([p[k] for p in parts], axis=-1) for k in parts[0]}
    with_thresholds(out, bins)
    out["value"] = node_values(spec, np.ascontiguousarray(out.pop("sums").T))
    del out["after"]
    out["cut"] = out["cut"].astype(np.uint8)
    return out


def _counted(packed: Packed, doubles: list[np.ndarray], rows: np.ndarray, node: np.ndarray, value: np.ndarray, nodes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_packed_cuts`` of the rows of ``nodes``, counted into all their bins."""
    if len(nodes) < total.shape[1]:
        to = np.zeros(total.shape[1], dtype=np.int64)
        to[nodes] = np.arange(len(nodes))
        node, total = to[node], total[:, nodes]
    cell = (node << 8) | value
    cells = [np.bincount(cell, weights=w[rows], minlength=len(nodes) * 256) for w in doubles]
    key = np.flatnonzero(cells[-1])  # the count is in the last word
    which, *found = _packed_cuts(packed, key, [np.cumsum(c[key].astype(np.int64)) for c in cells], total)
    return nodes[which], *found


def _ordered(packed: Packed, rows: np.ndarray, node: np.ndarray, value: np.ndarray, total: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """``_packed_cuts`` of rows sorted by node and bin; the rows, nodes and bins in that order."""
    key = node << 8
    key |= value
    key <<= 32
    key |= rows
    key.sort()
    rows = key & 0xFFFFFFFF
    key >>= 32
    last = np.empty(len(key), dtype=bool)
    last[-1:] = True
    np.not_equal(key[1:], key[:-1], out=last[:-1])
    end = np.flatnonzero(last)
    return _packed_cuts(packed, key[end], [np.cumsum(w[rows])[end] for w in packed.words], total), (rows, key >> 8, key.astype(np.uint8))


def grow_together(spec: Spec, bins: list[Bins], x: np.ndarray, count: np.ndarray, stats: np.ndarray, root: np.ndarray, seeds: np.ndarray, depth: int = 0
                  ) -> dict[str, np.ndarray]:
    """Subtrees of several nodes at ``depth``, a level of all of them at a time; ``root`` is the node of each cell, and the roots come first.

    Arrays over nodes: feature (-1: leaf), cut, threshold, left (the right child follows it), n, depth, gain, value.
    """
    grow = _grow_drawn if spec.classes and spec.tries == 1 else _grow_any
    return grow(spec, bins, x, count, stats, root, seeds, depth)


def _grow_any(spec: Spec, bins: list[Bins], x: np.ndarray, count: np.ndarray, stats: np.ndarray, root: np.ndarray, seeds: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """``grow_together`` for values, and for classes where a node looks at several features."""
    rows, cur, used = np.arange(len(x)), root, 0
    columns = np.ascontiguousarray(stats.T)
    parts = []
    n = np.bincount(cur, weights=count, minlength=len(seeds)).astype(np.int64)
    s = None
    while len(seeds):
        m = len(seeds)
        if s is None or not spec.classes:
            s = np.stack([np.bincount(cur, weights=c[rows], minlength=m) for c in columns]).T
        level = {"feature": np.full(m, -1, np.int16), "cut": np.zeros(m, np.uint8), "threshold": np.zeros(m), "left": np.zeros(m, np.int32), "n": n,
                 "depth": np.full(m, depth, np.int32), "gain": np.zeros(m), "value": node_values(spec, s)}
        parts.append(level)
        used += m
        live = np.flatnonzero((n >= max(spec.min_split, 2)) & is_impure(spec, s)) if depth < spec.deepest else np.zeros(0, int)
        if not len(live):
            break
        place = np.full(m, -1)
        place[live] = np.arange(len(live))
        cur = place[cur]
        stay = np.flatnonzero(cur >= 0)
        rows, cur = rows[stay], cur[stay]
        cut = _node_cuts(spec, bins, x, count, columns, rows, cur, seeds[live])
        ok = np.flatnonzero(cut["feature"] >= 0)
        split = live[ok]
        for c in ("feature", "cut", "threshold"):
            level[c][split] = cut[c][ok]
        level["left"][split] = used + 2 * np.arange(len(ok))
        level["gain"][split] = cut["score"][ok] - node_score(spec, s[split].T)
        side = x[rows, cut["feature"][cur]] > cut["cut"][cur]
        place = np.full(len(live), -1)
        place[ok] = np.arange(len(ok))
        cur = place[cur]
        if len(ok) < len(live):
            stay = np.flatnonzero(cur >= 0)
            rows, cur, side = rows[stay], cur[stay], side[stay]
        cur = 2 * cur + side
        left_n = cut["left_n"][ok]
        n = np.stack([left_n, n[split] - left_n], axis=1).reshape(-1)
        if spec.classes:  # exact
            left = cut["left"].T[:, ok]
            s = np.stack([left, s.T[:, split] - left], axis=2).reshape(spec.classes, -1).T
        seeds = child_seeds(seeds[split]).reshape(-1)
        depth += 1
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _parents(tree: dict[str, np.ndarray]) -> np.ndarray:
    """The node above each node; roots are their own."""
    inner = np.flatnonzero(tree["feature"] >= 0)
    out = np.arange(len(tree["feature"]))
    out[tree["left"][inner]] = out[tree["left"][inner] + 1] = inner
    return out


def _levels(tree: dict[str, np.ndarray]):
    """The nodes of each level below the roots, as slices."""
    start = np.flatnonzero(np.r_[True, tree["depth"][1:] != tree["depth"][:-1], True])
    return [slice(a, b) for a, b in zip(start[1:-1], start[2:])]


def apart(tree: dict[str, np.ndarray], roots: int) -> list[dict[str, np.ndarray]]:
    """The trees that ``grow_together`` has grown, one by one."""
    if roots == 1:
        return [tree]
    parent, owner = _parents(tree), np.arange(len(tree["feature"]))
    for level in _levels(tree):
        owner[level] = owner[parent[level]]
    out = []
    for r in range(roots):
        own = np.flatnonzero(owner == r)
        one = {k: v[own] for k, v in tree.items()}
        one["left"] = np.where(one["feature"] >= 0, np.searchsorted(own, one["left"]), 0).astype(np.int32)
        out.append(one)
    return out


def descend(tree: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The leaf of each binned row."""
    at = np.zeros(len(x), dtype=np.int64) if at is None else at
    # What a step needs of a node in one number: left child, feature, cut; -1: a leaf.
    step = np.where(tree["feature"] < 0, -1, (tree["left"].astype(np.int64) << 24) | (tree["feature"].astype(np.int64) << 8) | tree["cut"])
    flat, features = np.ascontiguousarray(x).reshape(-1), x.shape[1]
    here = step[at]
    active = np.flatnonzero(here >= 0)
    here = here[active]
    while len(active):
        to = (here >> 24) + (flat[active * features + ((here >> 8) & 0xFFFF)] > (here & 255))
        at[active] = to
        here = step[to]
        stay = np.flatnonzero(here >= 0)
        if len(stay) < len(active):
            active, here = active[stay], here[stay]
    return at


def cut_off(tree: dict[str, np.ndarray], cuts: list[tuple[int, int]]) -> np.ndarray:
    """(cuts, nodes): where a row that reaches a node ends in the tree cut off at a (depth, split size)."""
    parent = _parents(tree)
    ends = np.stack([(tree["depth"] >= depth) | (tree["n"] < small) for depth, small in cuts])
    out = np.tile(np.arange(len(parent), dtype=np.int32), (len(cuts), 1))
    for level in _levels(tree):
        above = parent[level]
        ended = ends[:, above]
        out[:, level] = np.where(ended, out[:, above], out[:, level])
        ends[:, level] |= ended
    return out


def nested_values(tree: dict[str, np.ndarray], x: np.ndarray, cuts: list[tuple[int, int]], above: list[tuple[int, int, np.ndarray]] = (), roots: int = 1):
    """For each of the trees grown together: values (cuts, rows, outputs) of the tree cut off at each (depth, split size).

    ``above`` has (depth, n, value) of the nodes over the subtree, from the root.
    """
    ends = cut_off(tree, cuts)
    for r in range(roots):
        out = tree["value"][ends[:, descend(tree, x, np.full(len(x), r, dtype=np.int64))]]
        for i, (depth, small) in enumerate(cuts):
            early = next((v for d, n, v in above if d >= depth or n < small), None)
            if early is not None:
                out[i] = early
        yield out


# ------------------------------------------------------------------ bins and the binned table
def fit_bins(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[Bins]:
    """Bins of each feature.  At most ``max_bins`` values: one bin each, so no cut is lost.  More: quantiles."""
    numbers = df.select(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])

    def distinct(batches):
        seen: list = [np.zeros(0) for _ in features]
        for batch in batches:
            for i, have in enumerate(seen):
                if have is not None:
                    v = np.unique(np.concatenate([have, batch.column(i).to_numpy(zero_copy_only=False)]))
                    seen[i] = v if len(v) <= max_bins else None
        f = [i for i, v in enumerate(seen) for _ in range(1 if v is None else len(v))]
        v = [x for have in seen for x in ([None] if have is None else have.tolist())]
        yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int32()), "v": pa.array(v, pa.float64())})

    values = numbers.mapInArrow(distinct, "f int, v double").distinct()
    facts = values.groupBy("f").agg(F.count("*").alias("n"), F.max(F.col("v").isNull()).alias("more"))
    small = values.join(facts.where((F.col("n") <= max_bins) & ~F.col("more")), "f").select("f", "v").collect()  # max_bins a feature
    exact: dict[int, list[float]] = {}
    for r in small:
        exact.setdefault(r["f"], []).append(r["v"])
    rest = [i for i in range(len(features)) if i not in exact]
    probs = [k / max_bins for k in range(1, max_bins)]
    cuts = numbers.agg(*[F.percentile_approx(f"f{i}", probs, 100 * max_bins).alias(f"f{i}") for i in rest]).first() if rest else {}
    out = []
    for i in range(len(features)):
        if i in exact:
            v = np.sort(np.array(exact[i]))
            out.append(Bins((v[1:] + v[:-1]) / 2, v, v))
        else:
            e = np.unique(np.array(cuts[f"f{i}"] or [], dtype=np.float64))
            out.append(Bins(e, np.r_[e[:1], e], np.r_[e, e[-1:]]))
    return out


def to_bins(bins: list[Bins], columns: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b.edges, c, side="left") for b, c in zip(bins, columns)], axis=1).astype(np.uint8)


def binned_table(df: DataFrame, features: list[str], bins: list[Bins], y, fold, key: list[str] | None = None) -> DataFrame:
    """A written table ``id, h, fold, y, x``: a row number, a hash of the key, and one byte a feature."""
    spark = df.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(bins)
    by = [F.col(f"`{c}`") for c in (key or [c for c in df.columns if not c.startswith("_")])]
    numbers = df.select(F.xxhash64(*by).alias("h"), fold.cast("int").alias("fold"), y.cast("double").alias("y"),
                        *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])

    numbers = numbers.select(F.monotonically_increasing_id().alias("id"), "*")

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_bins(held.value, [batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], binary_matrix(x)], names=["id", "h", "fold", "y", "x"])

    schema = "id long, h long, fold int, y double, x binary"
    path = scratch_path(spark, "binned-rows")
    numbers.mapInArrow(pack, schema).write.parquet(path)
    return spread(spark.read.schema(schema).parquet(path))


def binary_matrix(values: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column with the bytes of each row."""
    raw = np.ascontiguousarray(values)
    width = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def binary_rows(column: pa.Array, width: int) -> np.ndarray:
    """Back to bytes: a row of ``width`` bytes for each value (no nulls)."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = np.frombuffer(offsets, dtype=kind)[column.offset]
    return np.frombuffer(data, dtype=np.uint8)[first:first + len(column) * width].reshape(-1, width).copy()


@dataclass
class Rows:
    id: np.ndarray
    h: np.ndarray
    fold: np.ndarray
    y: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, features: int) -> Rows:
        return cls(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h", "fold", "y")], binary_rows(batch.column("x"), features))

    @classmethod
    def many(cls, batches, features: int, size: int | None = None):
        """The batches put together to about ``size`` rows."""
        size = size or PASS_ROWS
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(cls.of(batch, features))
                n += batch.num_rows
            if n >= size:
                yield cls._together(held)
                held, n = [], 0
        if held:
            yield cls._together(held)

    @classmethod
    def _together(cls, held: list[Rows]) -> Rows:
        return cls(*[np.concatenate([getattr(r, c) for r in held]) for c in ("id", "h", "fold", "y", "x")])

    def pack(self, which: np.ndarray, train: bool, classes: int) -> bytes:
        """Rows to learn from need no number, others no hash; classes below 256 take a byte."""
        y = self.y[which].astype(np.uint8) if 0 < classes < 256 else self.y[which]
        return pickle.dumps((None if train else self.id[which], self.h[which] if train else None, y, self.x[which]), protocol=5)

    @staticmethod
    def unpack(blocks) -> tuple[np.ndarray, ...]:
        """(numbers or None, hashes or None, targets, bins)"""
        parts = [pickle.loads(b) for b in blocks]
        out = [None if parts[0][i] is None else np.concatenate([p[i] for p in parts]) for i in range(4)]
        return out[0], out[1], out[2].astype(np.float64), out[3]


# ------------------------------------------------------------------ step 1: levels of large nodes
@dataclass
class Top:
    """The part of a tree grown by aggregates: arrays as those of ``grow``; open nodes are leaves so far, other leaves are final."""

    seed: np.uint64
    nodes: list[dict]

    @classmethod
    def root(cls, seed: np.uint64) -> Top:
        return cls(seed, [{"feature": -1, "cut": 0, "threshold": 0.0, "left": 0, "n": 0, "depth": 0, "gain": 0.0, "value": None, "seed": seed, "parent": -1, "open": True}])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feature": np.array([v["feature"] for v in self.nodes]), "cut": np.array([v["cut"] for v in self.nodes]), "left": np.array([v["left"] for v in self.nodes])}

    def above(self, node: int) -> list[tuple[int, int, np.ndarray]]:
        out, at = [], self.nodes[node]["parent"]
        while at >= 0:
            v = self.nodes[at]
            out.append((v["depth"], v["n"], v["value"]))
            at = v["parent"]
        return out[::-1]


def grow_tops(table: DataFrame, spec: Spec, bins: list[Bins], forests: list[int], sizes: dict[int, int], local_rows: int) -> dict[tuple[int, int], Top]:
    """The nodes of more than ``local_rows`` rows of every tree of every forest (forest f learns from the rows of other folds)."""
    spark, features = table.sparkSession, len(bins)
    tops = {(f, t): Top.root(tree_seed(spec, t)) for f in forests for t in range(spec.trees)}
    todo = [(f, t, 0) for f, t in tops if sizes[f] > local_rows]
    width = spec.classes or 3
    wave = max(1, CELLS_AT_ONCE // (features * 256 * (width + 1)))
    while todo:
        slots, todo = todo[:wave], todo[wave:]
        trees = sorted({(f, t) for f, t, _ in slots})
        plan = spark.sparkContext.broadcast(([(f, t, tops[f, t].seed, tops[f, t].arrays(), {n: i for i, (f2, t2, n) in enumerate(slots) if (f2, t2) == (f, t)})
                                              for f, t in trees], np.array([tops[f, t].nodes[n]["seed"] for f, t, n in slots], dtype=np.uint64)))

        def cells(batches):
            total = np.zeros((len(slots), features, 256, width + 1))
            for rows in Rows.many(batches, features):
                for f, _, seed, arrays, wanted in plan.value[0]:
                    w = row_weights(spec, seed, rows.h)
                    own = np.flatnonzero((w > 0) & (rows.fold != f))
                    node = descend(arrays, rows.x[own])
                    slot = np.full(len(arrays["feature"]), -1)
                    slot[list(wanted)] = np.arange(len(wanted))
                    slot = slot[node]
                    own, slot = own[slot >= 0], slot[slot >= 0]
                    columns = [None, *row_stats(spec, rows.y[own], w[own]).T]
                    mine = list(wanted.values())
                    for j in range(features):
                        cell = slot * 256 + rows.x[own, j]
                        for i, v in enumerate(columns):
                            total[mine, j, :, i] += np.bincount(cell, weights=v, minlength=256 * len(mine)).reshape(-1, 256)
            total = total.reshape(-1, width + 1)
            hit = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_pydict({"slot": pa.array(hit // (features * 256), pa.int32()), "f": pa.array(hit // 256 % features, pa.int32()),
                                              "bin": pa.array(hit % 256, pa.int32()), "n": pa.array(total[hit, 0].astype(np.int64)),
                                              **{f"s{i}": pa.array(total[hit, i + 1]) for i in range(width)}})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["f", "bin"])
            seeds = plan.value[1][[int(pdf["slot"].iloc[0])]]
            found = []
            for _, own in pdf.groupby("f"):
                s = own[[f"s{i}" for i in range(width)]].to_numpy().T
                found.append(best_cuts(spec, np.zeros(len(own), dtype=int), own["bin"].to_numpy(), own["n"].to_numpy(), s, 1))
            total, n = s.sum(axis=1), int(own["n"].sum())
            cut = choose(spec, seeds, found, bins)
            return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "n": [n], "total": [total.tolist()], "feature": cut["feature"], "cut": cut["cut"],
                                 "threshold": cut["threshold"], "score": cut["score"], "left_n": cut["left_n"], "left": [cut["left"][0].tolist()]})

        sums = ", ".join(f"s{i} double" for i in range(width))
        summed = table.mapInArrow(cells, f"slot int, f int, bin int, n long, {sums}").groupBy("slot", "f", "bin").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        found = summed.groupBy("slot").applyInPandas(split, "slot int, n long, total array<double>, feature int, cut int, threshold double, score double, left_n long, left array<double>")
        for r in found.collect():  # a row an open node
            f, t, n = slots[r["slot"]]
            top = tops[f, t]
            node, total = top.nodes[n], np.array([r["total"]])
            node.update(n=r["n"], value=node_values(spec, total)[0])
            node["open"] = False
            own = spec.of(t)
            if r["feature"] < 0 or node["depth"] >= own.deepest or r["n"] < max(own.min_split, 2) or not is_impure(spec, total)[0]:
                continue
            node.update(feature=r["feature"], cut=r["cut"], threshold=r["threshold"], left=len(top.nodes), gain=r["score"] - node_score(spec, total.T)[0])
            for side, seed in enumerate(child_seeds(np.array([node["seed"]], dtype=np.uint64))[0]):
                size = r["left_n"] if side == 0 else r["n"] - r["left_n"]
                top.nodes.append({"feature": -1, "cut": 0, "threshold": 0.0, "left": 0, "n": size, "depth": node["depth"] + 1, "gain": 0.0, "value": None, "seed": seed, "parent": n, "open": True})
                if size > local_rows:
                    todo.append((f, t, len(top.nodes) - 1))
        plan.unpersist()
    return tops


# ------------------------------------------------------------------ step 2: subtrees, a group of rows a task
def _dealt(table: DataFrame, spec: Spec, features: int, forests: list[int], tops, chunk: int, parts: int) -> DataFrame:
    """Blocks of rows by (forest, first tree of a chunk, node, part); training rows of open nodes go to every part, test rows to one."""
    held = table.sparkSession.sparkContext.broadcast({k: (v.seed, v.arrays(), np.array([n["open"] for n in v.nodes])) for k, v in tops.items()})

    names = ("forest", "tree", "node", "part", "train", "block")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def blocks(rows: Rows):
        part = (mix(rows.id.view(np.uint64)) % np.uint64(parts)).astype(int)

        def packed(mine: np.ndarray, train: np.ndarray, test: np.ndarray, is_open: bool) -> list[tuple[int, bool, bytes]]:
            out = []
            if is_open and (ids := np.flatnonzero(mine & train)).size:  # the rows of a final leaf are not needed
                block = rows.pack(ids, True, spec.classes)
                out += [(p, True, block) for p in range(parts)]
            return out + [(p, False, rows.pack(ids, False, spec.classes)) for p in range(parts) if (ids := np.flatnonzero(mine & test & (part == p))).size]

        for f in forests:
            learn, whole = rows.fold != f, None
            for t in range(0, spec.trees, chunk):
                seed, arrays, is_open = held.value[f, t]
                if len(arrays["feature"]) == 1:  # the same rows for all trees
                    whole = packed(np.ones(len(learn), dtype=bool), learn, ~learn, is_open[0]) if whole is None else whole
                    yield from ((f, t, 0, *one) for one in whole)
                    continue
                node, train = descend(arrays, rows.x), learn & (row_weights(spec, seed, rows.h) > 0)
                for n in np.unique(node):
                    yield from ((f, t, int(n), *one) for one in packed(node == n, train, ~learn, is_open[n]))

    def deal(batches):
        out, size = [], 0
        for rows in Rows.many(batches, features):
            for one in blocks(rows):
                out.append(one)
                size += len(one[-1])
                if size >= DEALT_BYTES:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate(zip(names, kinds))})
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate(zip(names, kinds))})

    return table.mapInArrow(deal, "forest int, tree int, node int, part int, train boolean, block binary")


def _subtrees(spec: Spec, bins: list[Bins], f: int, first: int, node: int, chunk: int, tops, train):
    """(tree numbers, their subtrees grown together, nodes above them) of the trees of a chunk, about ``GROWN_CELLS`` cells at a time."""
    _, h, y, x = train
    order = np.lexsort((y, h))  # the same sums whatever order the blocks came in
    trees = [(t, tops[f, t].seed) for t in range(first, min(first + chunk, spec.trees))]
    held: list[tuple] = []

    def grown():
        seeds = np.array([tops[f, t].nodes[node]["seed"] for t, *_ in held], dtype=np.uint64)
        root = np.repeat(np.arange(len(held)), [len(c[1]) for c in held])
        cells = [np.concatenate([c[i] for c in held]) for i in (1, 2, 3)]
        return [c[0] for c in held], grow_together(spec.of(held[0][0]), bins, *cells, root, seeds, tops[f, held[0][0]].nodes[node]["depth"]), tops[f, held[0][0]].above(node)

    for cells in cells_by_tree(spec, x[order], y[order], h[order], trees):
        held.append(cells)
        if sum(len(c[1]) for c in held) >= GROWN_CELLS:
            yield grown()
            held = []
    if held:
        yield grown()


def _prepare(table: DataFrame, spec: Spec, bins: list[Bins], forests: list[int], local_rows: int):
    counts = {r["fold"]: r["n"] for r in table.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    total = sum(counts.values())
    sizes = {f: total - counts.get(f, 0) for f in forests}
    tops = grow_tops(table, spec, bins, forests, sizes, local_rows)
    small = all(len(v.nodes) == 1 for v in tops.values())
    chunk = max(1, min(10, len(forests) * spec.trees // (8 * table.sparkSession.sparkContext.defaultParallelism))) if small else 1
    parts = max(1, -(-max(counts.get(f, 0) for f in forests) // local_rows))
    return tops, _dealt(table, spec, len(bins), forests, tops, chunk, parts), chunk, total


def _by_work(dealt: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Dealt by keys to a number of tasks that follows the groups: they are small in bytes, and long in time."""
    sc = dealt.sparkSession.sparkContext
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, 16 * sc.defaultParallelism))
    return dealt.repartition(tasks, *keys)


def fit_trees(table: DataFrame, spec: Spec, bins: list[Bins], local_rows: int | None = None) -> list[dict[str, np.ndarray]]:
    """The trees of one forest over all rows of the table (fold -1)."""
    own_rows = local_rows or (CLASS_ROWS if spec.classes else LOCAL_ROWS)
    local_rows = local_rows or LOCAL_ROWS
    if cells_fit(table, len(bins), local_rows):
        return _fit_from_cells(table, spec, bins)
    tops, dealt, chunk, _ = _prepare(table, spec, bins, [0], own_rows)
    held = table.sparkSession.sparkContext.broadcast((tops, bins))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        f, first, node = (int(pdf[c].iloc[0]) for c in ("forest", "tree", "node"))
        grown = _subtrees(spec, held.value[1], f, first, node, chunk, held.value[0], Rows.unpack(pdf["block"]))
        out = [(t, node, pickle.dumps(one, protocol=5)) for trees, sub, _ in grown for t, one in zip(trees, apart(sub, len(trees)))]
        return pd.DataFrame(out, columns=["tree", "node", "block"])

    keys = ("forest", "tree", "node", "part")
    grown = _by_work(dealt, -(-spec.trees // chunk), *keys).groupBy(*keys).applyInPandas(finish, "tree int, node int, block binary")
    path = scratch_path(table.sparkSession, "forest")
    grown.write.parquet(path)
    grown = table.sparkSession.read.schema("tree int, node int, block binary").parquet(path)
    _check_size(grown)
    subtrees: dict[int, dict[int, dict]] = {}
    for r in grown.collect():
        subtrees.setdefault(r["tree"], {})[r["node"]] = pickle.loads(r["block"])
    return [_joined(spec, tops[0, t], subtrees.get(t, {})) for t in range(spec.trees) if t in subtrees or tops[0, t].nodes[0]["value"] is not None]


def _check_size(grown: DataFrame) -> None:
    size = grown.agg(F.sum(F.length("block"))).first()[0] or 0
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"the forest has {size >> 20} MB of nodes; bound max_depth, or score with nested_scores, which broadcasts no trees")


def _joined(spec: Spec, top: Top, subtrees: dict[int, dict]) -> dict[str, np.ndarray]:
    """One tree: the top, with each finished node replaced by its subtree."""
    if len(top.nodes) == 1 and subtrees:
        return subtrees[0]
    k = spec.classes or 1
    parts = {c: [np.array([v[c] for v in top.nodes])] for c in ("feature", "cut", "threshold", "left", "n", "depth", "gain")}
    parts["value"] = [np.array([np.zeros(k) if v["value"] is None else v["value"] for v in top.nodes])]
    used = len(top.nodes)
    for node, sub in subtrees.items():
        shift = used - 1  # node 0 of the subtree takes the place of the top's node
        for c in parts:
            parts[c][0][node] = sub[c][0]
            parts[c].append(sub[c][1:])
        parts["left"][0][node] = sub["left"][0] + shift
        parts["left"][-1] = sub["left"][1:] + shift
        used += len(sub["feature"]) - 1
    return {c: np.concatenate(v) for c, v in parts.items()}


# ------------------------------------------------------------------ both steps by cells of equal rows
def cells_fit(table: DataFrame, features: int, local_rows: int) -> bool:
    """Whether there are more rows than ``local_rows``, but no more different ones (equal bins)."""
    if not table.where("true").limit(local_rows + 1).count() > local_rows:
        return False
    return table.select("x").distinct().count() <= local_rows


def _drawn_cells(table: DataFrame, spec: Spec, features: int, folds: bool) -> DataFrame:
    """``tree, block``: each tree's cells (bins, fold, rows drawn, sums) of a share of the rows; cells without a drawn row are among them.

    The shares are ranges of (bins, key hash), of equal size whatever the bins.
    """
    sc = table.sparkSession.sparkContext
    parts = max(2 * sc.defaultParallelism, -(-table.count() // LOCAL_ROWS))

    def draw(batches):
        for rows in Rows.many(batches, features, LOCAL_ROWS):
            order = np.lexsort((rows.y, rows.h))  # the same sums whatever order the rows came in
            x, h, y, fold = rows.x[order], rows.h[order], rows.y[order], rows.fold[order]
            codes = row_codes(x)
            _, first, place = np.unique(codes, return_index=True, return_inverse=True)
            if folds:
                _, first, place = np.unique(place * (int(fold.max()) + 2) + fold + 1, return_index=True, return_inverse=True)
            for t in range(spec.trees):
                w = row_weights(spec, tree_seed(spec, t), h)
                drawn = np.bincount(place, weights=w > 0, minlength=len(first)).astype(np.int64)
                stats = np.stack([np.bincount(place, weights=c, minlength=len(first)) for c in row_stats(spec, y, w).T], axis=1)
                keep = np.arange(len(first)) if folds else np.flatnonzero(drawn)
                block = pickle.dumps((x[first[keep]], fold[first[keep]], drawn[keep], stats[keep]), protocol=5)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "block": pa.array([block], pa.binary())})

    return table.select("id", "h", "fold", "y", "x").repartitionByRange(parts, "x", "h").mapInArrow(draw, "tree int, block binary")


def _cells_of(blocks) -> tuple[np.ndarray, ...]:
    parts = [pickle.loads(b) for b in blocks]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def _fit_from_cells(table: DataFrame, spec: Spec, bins: list[Bins]) -> list[dict[str, np.ndarray]]:
    spark = table.sparkSession
    held = spark.sparkContext.broadcast(bins)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x, _, n, stats = _cells_of(pdf["block"])
        out = [(t, pickle.dumps(grow_cells(spec, held.value, *merged(x, n, stats), tree_seed(spec, t)), protocol=5))] if len(x) else []
        return pd.DataFrame(out, columns=["tree", "block"])

    path = scratch_path(spark, "forest")
    _by_work(_drawn_cells(table, spec, len(bins), False), spec.trees, "tree").groupBy("tree").applyInPandas(finish, "tree int, block binary").write.parquet(path)
    grown = spark.read.schema("tree int, block binary").parquet(path)
    _check_size(grown)
    return [pickle.loads(r["block"]) for r in sorted(grown.collect(), key=lambda r: r["tree"])]


def tree_importances(trees: list[dict[str, np.ndarray]], features: int) -> np.ndarray:
    """Impurity decrease a feature, each tree's adding up to 1, averaged and scaled to add up to 1."""
    total = np.zeros(features)
    for tree in trees:
        inner = tree["feature"] >= 0
        own = np.bincount(tree["feature"][inner], weights=tree["gain"][inner], minlength=features)
        total += own / own.sum() if own.sum() > 0 else 0.0
    return total / total.sum() if total.sum() > 0 else total


# ------------------------------------------------------------------ nested evaluation
def nested_scores(table: DataFrame, spec: Spec, bins: list[Bins], forests: list[int], tree_counts: list[int], depths: list[int | None], splits: list[int],
                  local_rows: int | None = None, wanted: set[tuple] | None = None) -> DataFrame:
    """``forest, n_estimators, max_depth, min_samples_split`` with ``n, correct, abs_error, sq_error, sum_y, sum_y2`` over the rows of fold ``forest``.

    One forest a fold is grown; its prefixes, cut-off depths and cut-off split sizes are the candidates.  (Sums of y are about ``spec.shift``.)
    Only those of ``wanted`` (n_estimators, max_depth, min_samples_split) are needed, if it is given: a tree grows as far as they ask.
    """
    own_rows = local_rows or (CLASS_ROWS if spec.classes else LOCAL_ROWS)
    local_rows = local_rows or LOCAL_ROWS
    tree_counts, splits = sorted(tree_counts), sorted(splits)
    limits = [UNLIMITED if d is None else d for d in depths]
    full = replace(spec, trees=tree_counts[-1], depth=None if None in depths else max(limits), min_split=min(splits))
    if cells := nested_cells(table, local_rows):
        return _scores_from_cells(table, full, bins, forests, tree_counts, depths, splits, cells)
    candidates = [(n, d, s) for n in tree_counts for d in depths for s in splits if wanted is None or (n, d, s) in wanted]
    nested = [(n, UNLIMITED if d is None else d, s) for n, d, s in candidates]
    cuts = sorted({c[1:] for c in nested})
    full = replace(full, nested=tuple(nested))
    tops, dealt, chunk, total = _prepare(table, full, bins, forests, own_rows)
    held = table.sparkSession.sparkContext.broadcast((tops, bins))
    blocks = max(1, total // BLOCK_ROWS)
    outputs = spec.classes or 1

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        f, first, node = (int(pdf[c].iloc[0]) for c in ("forest", "tree", "node"))
        train, test = pdf[pdf["train"]], pdf[~pdf["train"]]
        out = []
        top = held.value[0][f, first]
        leaf = top.nodes[node]
        if len(test) and (len(train) or not leaf["open"]):
            ids, _, y, x = Rows.unpack(test["block"])
            asked = [i for i, c in enumerate(cuts) if any(n > first and (d, s) == c for n, d, s in nested)]
            sums: dict[int, np.ndarray] = {}
            if leaf["open"]:
                grown = _subtrees(full, held.value[1], f, first, node, chunk, held.value[0], Rows.unpack(train["block"]))
            else:
                grown = [([first], {k: np.array([leaf[k]]) for k in ("feature", "cut", "left", "n", "depth", "value")}, top.above(node))]
            for trees, sub, above in grown:
                for t, v in zip(trees, nested_values(sub, x, [cuts[i] for i in asked], above, len(trees))):
                    segment = int(np.searchsorted(tree_counts, t, side="right"))
                    sums[segment] = sums[segment] + v if segment in sums else v
            block = (mix(ids.view(np.uint64)) % np.uint64(blocks)).astype(int)
            order = np.argsort(block, kind="stable")
            ids, y, block = ids[order], y[order], block[order]
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for segment, v in sums.items():
                v = v.transpose(1, 0, 2)[order]
                out += [(f, int(block[a]), segment, pickle.dumps((ids[a:b], y[a:b], asked, v[a:b]), protocol=5)) for a, b in zip(edges[:-1], edges[1:])]
        return pd.DataFrame(out, columns=["forest", "block", "segment", "values"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(s), *pickle.loads(b)) for s, b in zip(pdf["segment"], pdf["values"])]
        ids, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        y = np.empty(len(ids))
        total = np.zeros((len(tree_counts), len(ids), len(cuts), outputs))
        at = 0
        for segment, own, target, asked, values in parts:
            where = place[at:at + len(own)]
            at += len(own)
            y[where] = target
            total[segment, where[:, None], asked] += values
        running = np.cumsum(total, axis=0)
        out = []
        z = y - spec.shift
        for (trees, depth, small), (_, *cut) in zip(candidates, nested):
            v = running[tree_counts.index(trees), :, cuts.index(tuple(cut))]
            miss = (v[:, 0] / trees - y) if not spec.classes else np.zeros(len(y))
            right = int((v.argmax(axis=1) == y).sum()) if spec.classes else 0
            out.append((int(pdf["forest"].iloc[0]), trees, depth, small, len(y), right, float(np.abs(miss).sum()), float((miss ** 2).sum()),
                        float(z.sum()), float((z ** 2).sum())))
        return pd.DataFrame(out, columns=["forest", "n_estimators", "max_depth", "min_samples_split", "n", "correct", "abs_error", "sq_error", "sum_y", "sum_y2"]
                            ).astype({"max_depth": "Int32"})

    keys = ("forest", "tree", "node", "part")
    groups = len(forests) * -(-full.trees // chunk)
    values = _by_work(dealt, groups, *keys).groupBy(*keys).applyInPandas(score, "forest int, block int, segment int, values binary")
    rows = _by_work(values, len(forests) * blocks, "forest", "block").groupBy("forest", "block").applyInPandas(
        add, "forest int, n_estimators int, max_depth int, min_samples_split int, n long, correct long, abs_error double, sq_error double, sum_y double, sum_y2 double")
    return rows.groupBy("forest", "n_estimators", "max_depth", "min_samples_split").agg(
        *[F.sum(c).alias(c) for c in ("n", "correct", "abs_error", "sq_error", "sum_y", "sum_y2")])


def nested_cells(table: DataFrame, local_rows: int) -> int:
    """The number of different binned rows if a task takes so many and they are ``CELL_SHARE`` times fewer than the rows, else 0."""
    rows, cells = table.count(), table.select("x").distinct().count()
    return cells if cells <= local_rows and rows >= CELL_SHARE * cells else 0


def _scores_from_cells(table: DataFrame, spec: Spec, bins: list[Bins], forests: list[int], tree_counts: list[int], depths: list[int | None], splits: list[int],
                       cells: int) -> DataFrame:
    """``nested_scores`` from cells: one pass draws the trees, a tree of every fold grows in one task, and its values at the fold's own
    cells are added up; then the rows meet the values of their cell."""
    spark, features, outputs = table.sparkSession, len(bins), spec.classes or 1
    limits = [UNLIMITED if d is None else d for d in depths]
    held = spark.sparkContext.broadcast(bins)
    chunk = max(1, min(10, spec.trees // (4 * spark.sparkContext.defaultParallelism), LOCAL_ROWS // cells))
    blocks = max(1, cells // BLOCK_ROWS)
    shape = (len(tree_counts), len(limits), len(splits), outputs)
    cuts = [(d, small) for d in limits for small in splits]

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for t in sorted(pdf["tree"].unique()):
            x, fold, n, stats = _cells_of(pdf["block"][pdf["tree"] == t])
            segment = int(np.searchsorted(tree_counts, t, side="right"))
            for f in forests:
                learn, own = (fold != f) & (n > 0), fold == f
                if not learn.any() or not own.any():
                    continue
                tree = grow_cells(spec, held.value, *merged(x[learn], n[learn], stats[learn]), tree_seed(spec, int(t)))
                test = x[own][np.unique(row_codes(x[own]), return_index=True)[1]]  # in the same order for every tree
                v = next(nested_values(tree, test, cuts)).transpose(1, 0, 2).reshape(len(test), *shape[1:])
                sums[f, segment] = (test, sums[f, segment][1] + v if (f, segment) in sums else v)
        out = []
        for (f, segment), (test, v) in sums.items():
            block = cell_block(test, blocks)
            out += [(f, int(b), segment, pickle.dumps((test[block == b], v[block == b]), protocol=5)) for b in np.unique(block)]
        return pd.DataFrame(out, columns=["fold", "block", "segment", "values"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(((int(s), *pickle.loads(b)) for s, b in zip(pdf["segment"], pdf["values"])), key=lambda p: p[0])
        _, first, place = np.unique(row_codes(np.concatenate([p[1] for p in parts])), return_index=True, return_inverse=True)
        total = np.zeros((len(first), *shape))
        at = 0
        for segment, x, v in parts:
            total[place[at:at + len(x)], segment] += v
            at += len(x)
        running = np.cumsum(total, axis=1)
        x = np.concatenate([p[1] for p in parts])[first]
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "x": [r.tobytes() for r in x], "values": [v.tobytes() for v in running]})

    def pack(batches):
        """Targets of rows of one cell and fold together, at most BLOCK_ROWS of them."""
        for rows in Rows.many(batches, features):
            codes = np.unique(row_codes(rows.x), return_inverse=True)[1]
            order = np.lexsort((codes, rows.fold))
            fold, codes = rows.fold[order], codes[order]
            start = np.flatnonzero(np.r_[True, (fold[1:] != fold[:-1]) | (codes[1:] != codes[:-1])])
            start = np.concatenate([np.arange(a, b, BLOCK_ROWS) for a, b in zip(start, np.r_[start[1:], len(order)])])
            y = [rows.y[order[a:b]].tobytes() for a, b in zip(start, np.r_[start[1:], len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(fold[start], pa.int32()), binary_matrix(rows.x[order[start]]), pa.array(y, pa.binary())], names=["fold", "x", "y"])

    def score(batches):
        total: dict[int, np.ndarray] = {}
        counts = np.array(tree_counts, dtype=float)[:, None, None]
        for batch in batches:
            for f, raw, own in zip(*[batch.column(c).to_pylist() for c in ("fold", "y", "values")]):
                y, v = np.frombuffer(raw), np.frombuffer(own).reshape(shape)
                sums = total.setdefault(f, np.zeros((6, *shape[:3])))
                z = y - spec.shift
                sums[0] += len(y)
                if spec.classes:
                    sums[1] += np.bincount(y.astype(int), minlength=outputs)[v.argmax(axis=-1)]
                else:
                    miss = (v[..., 0] / counts)[..., None] - y
                    sums[2] += np.abs(miss).sum(axis=-1)
                    sums[3] += (miss * miss).sum(axis=-1)
                sums[4] += z.sum()
                sums[5] += (z * z).sum()
        out = [(f, trees, depth, small, int(s[0, i, j, k]), int(s[1, i, j, k]), *map(float, s[2:, i, j, k])) for f, s in total.items()
               for i, trees in enumerate(tree_counts) for j, depth in enumerate(depths) for k, small in enumerate(splits)]
        if out:
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(_SCORED, _SCORED_KINDS))})

    drawn = _drawn_cells(table, spec, features, True).withColumn("chunk", F.floor(F.col("tree") / chunk))
    at_cells = _by_work(drawn, -(-spec.trees // chunk), "chunk").groupBy("chunk").applyInPandas(values, "fold int, block int, segment int, values binary")
    summed = at_cells.groupBy("fold", "block").applyInPandas(add, "fold int, x binary, values binary")
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-table.count() // LOCAL_ROWS))
    targets = table.where(F.col("fold").isin(forests)).repartitionByRange(parts, "fold", "x", "h").mapInArrow(pack, "fold int, x binary, y binary")
    scored = targets.join(summed, ["fold", "x"]).mapInArrow(score, ", ".join(f"{c} {k}" for c, k in zip(_SCORED, ["int"] * 4 + ["long"] * 2 + ["double"] * 4)))
    return scored.groupBy(*_SCORED[:4]).agg(*[F.sum(c).alias(c) for c in _SCORED[4:]])


_SCORED = ("forest", "n_estimators", "max_depth", "min_samples_split", "n", "correct", "abs_error", "sq_error", "sum_y", "sum_y2")
_SCORED_KINDS = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.float64()] * 4


def cell_block(x: np.ndarray, blocks: int) -> np.ndarray:
    """A number below ``blocks`` for each binned row, the same in every task."""
    h = np.zeros(len(x), dtype=np.uint64)
    for column in x.T:
        h = mix(h ^ column.astype(np.uint64))
    return (h % np.uint64(blocks)).astype(int)


# ------------------------------------------------------------------ prediction
def raw_values(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value of the leaf of each row of plain numbers."""
    at = np.zeros(len(x), dtype=np.int64)
    active = np.flatnonzero(tree["feature"][at] >= 0)
    while len(active):
        here = at[active]
        at[active] = tree["left"][here] + ~(x[active, tree["feature"][here]] <= tree["threshold"][here])
        active = active[tree["feature"][at[active]] >= 0]
    return tree["value"][at]


def forest_values(spark, trees: list[dict[str, np.ndarray]], features: list[str]):
    """Column: class probabilities, or an array of the mean, averaged over the trees."""
    keep = ("feature", "threshold", "left", "value")
    ship_package(spark)
    held = spark.sparkContext.broadcast([{k: t[k] for k in keep} for t in trees])  # at most MAX_MODEL_BYTES

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def values(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)
        return pd.Series(list(sum(raw_values(t, x) for t in held.value) / len(held.value)))

    return values(*[F.col(f"`{f}`").cast("double") for f in features])

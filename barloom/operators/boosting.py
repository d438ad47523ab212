"""Boosted trees fitted anew for every ticker and walk-forward fold.

Spark deals out tickers; a task holds one ticker's daily rows (the calendar bounds them) and fits its folds one after
another, so rows are not copied once per fold. Trees grow level by level from histograms of gradients and curvatures over
binned features, with the usual penalties: least curvature in a child, least gain, L1 and L2 on leaf values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.splits import expanding_folds


@dataclass(frozen=True)
class Boosting:
    #: The published model settings, down to ``holdout``.
    trees: int = 600
    depth: int = 3
    rate: float = 0.02
    subsample: float = 0.75
    column_share: float = 0.70
    min_child: float = 5.0
    gamma: float = 0.20
    l1: float = 0.15
    l2: float = 1.50
    patience: int = 40
    holdout: float = 0.15
    bins: int = 256
    seed: int = 42


def fold_predictions(rows: DataFrame, features: Sequence[str], label: str, settings: Boosting = Boosting(), **fold_options) -> DataFrame:
    """(ticker, fold, date, p, train_start, train_end, tr_rows, pos_weight, trees): every test bar of every fold, scored by a
    model that was fitted on the fold's training bars only.

    ``rows`` has one complete row per ticker and date. The last ``holdout`` of the training bars decides when to stop
    (0: all trees). Ties between splits go to the first feature, then the lowest threshold.
    """
    names = list(features)
    settings = SimpleNamespace(**asdict(settings))  # travels to tasks, which need not have this package

    def soft(g):
        return np.sign(g) * np.maximum(np.abs(g) - settings.l1, 0.0)

    def value(g, h):
        return soft(g) ** 2 / (h + settings.l2)

    def grown(codes, g, h, used, rng, width):
        """One tree as arrays (feature, threshold code, leaf value) over the nodes of a full tree, and each row's leaf."""
        n, d = codes.shape
        chosen = np.sort(rng.permutation(d)[: max(1, round(settings.column_share * d))])
        size = 2 ** (settings.depth + 1) - 1
        feature, cut = np.full(size, -1), np.zeros(size, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(settings.depth):
            first, count = 2**level - 1, 2**level
            here = np.flatnonzero(used & (node >= first))
            flat = (((node[here] - first) * len(chosen))[:, None] + np.arange(len(chosen))) * width + codes[here][:, chosen]
            shape = (count, len(chosen), width)
            gs, hs = (np.bincount(flat.ravel(), np.repeat(v[here], len(chosen)), np.prod(shape)).reshape(shape).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = value(gs, hs) + value(gt - gs, ht - hs) - value(gt, ht)
            gain[(hs < settings.min_child) | (ht - hs < settings.min_child)] = -np.inf
            flat_gain = gain.reshape(count, -1)
            best = flat_gain.argmax(axis=1)
            for k in range(count):
                if flat_gain[k, best[k]] > settings.gamma:
                    feature[first + k], cut[first + k] = chosen[best[k] // width], best[k] % width
            split = (node >= first) & (feature[node] >= 0)
            at = node[split]
            node[split] = 2 * at + 1 + (codes[split, feature[at]] > cut[at])
        gl, hl = (np.bincount(node[used], v[used], size) for v in (g, h))
        return feature, cut, -settings.rate * soft(gl) / (hl + settings.l2), node

    def leaf_of(tree, codes):
        feature, cut, _, _ = tree
        node = np.zeros(len(codes), np.int64)
        for _ in range(settings.depth):
            inner = feature[node] >= 0
            at = node[inner]
            node[inner] = 2 * at + 1 + (codes[inner, feature[at]] > cut[at])
        return node

    def fitted(x, y, weight):
        """Thresholds of each feature and the trees up to the best one on the held-out end."""
        n = len(y) - int(len(y) * settings.holdout)
        edges = []
        for column in x[:n].T:
            distinct = np.unique(column)
            if len(distinct) > settings.bins:
                distinct = np.unique(np.quantile(column, np.arange(1, settings.bins) / settings.bins, method="lower"))
            edges.append(distinct)
        codes = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)])
        width = max(map(len, edges)) + 1
        rng, w = np.random.default_rng(settings.seed), np.where(y == 1, weight, 1.0)
        z, trees, best, least = np.zeros(len(y)), [], 0, np.inf
        for _ in range(settings.trees):
            s = 1 / (1 + np.exp(-z[:n]))
            used = np.ones(n, bool) if settings.subsample >= 1 else rng.random(n) < settings.subsample
            tree = grown(codes[:n], w[:n] * (s - y[:n]), w[:n] * s * (1 - s), used, rng, width)
            trees.append(tree)
            z[:n] += tree[2][tree[3]]
            if n < len(y):
                z[n:] += tree[2][leaf_of(tree, codes[n:])]
                loss = float(np.mean(np.logaddexp(0.0, z[n:]) - y[n:] * z[n:]))
                if loss < least:
                    least, best = loss, len(trees)
                elif len(trees) - best >= settings.patience:
                    break
        return edges, trees[: best or len(trees)]

    def folds_of(series: pd.DataFrame, folds: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("date").reset_index(drop=True)
        x, y, out = series[names].to_numpy(np.float64), series[label].to_numpy(np.float64), []
        for fold in folds.sort_values("fold").itertuples():
            end, known = fold.train_end, y[: fold.train_end]
            positive = int((known == 1).sum())
            weight = (len(known) - positive) / positive if positive else 1.0
            edges, trees = fitted(x[:end], known, weight)
            test = series.iloc[fold.test_start : fold.test_end]
            codes = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x[fold.test_start : fold.test_end].T)])
            z = sum((tree[2][leaf_of(tree, codes)] for tree in trees), np.zeros(len(test)))
            out.append(pd.DataFrame({
                "ticker": test["ticker"], "fold": fold.fold, "date": test["date"], "p": 1 / (1 + np.exp(-z)),
                "train_start": series["date"].iloc[0], "train_end": series["date"].iloc[end - 1], "tr_rows": end,
                "pos_weight": weight, "trees": len(trees),
            }))
        schema_names = ["ticker", "fold", "date", "p", "train_start", "train_end", "tr_rows", "pos_weight", "trees"]
        return pd.concat(out)[schema_names] if out else pd.DataFrame(columns=schema_names)

    bounds = expanding_folds(rows, **fold_options).selectExpr("ticker AS _ticker", "fold", "train_end", "test_start", "test_end")
    schema = "ticker string, fold int, date date, p double, train_start date, train_end date, tr_rows long, pos_weight double, trees int"
    narrow = rows.select("ticker", "date", *names, label)
    return narrow.groupBy("ticker").cogroup(bounds.groupBy("_ticker")).applyInPandas(folds_of, schema)

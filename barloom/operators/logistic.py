"""Penalised logistic regressions of many groups at once, by Newton steps.

Each step is one aggregation: the gradient and the curvature of every group are sums over its rows, so a step costs one pass
with map-side combine whatever the number of groups, and only d x d numbers of each group reach the driver. Groups are few
(models, or models by ticker).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import num
from barloom.session import cut_lineage

STEPS, TOLERANCE = 50, 1e-10


def newton_logistic(
    rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], c: float = 1.0, cut: bool = True
) -> DataFrame:
    """(keys, intercept, weights array): least of the log losses' sum + |weights|² / 2c in each group; the intercept is free.

    Rows lacking a feature or the label are left out. A group without rows has no row; one label only gives a finite fit
    of the weights, with an intercept as far out as ``STEPS`` steps lead.
    """
    spark = rows.sparkSession
    x = ["1D", *[f"_x{i}" for i in range(len(features))]]
    d = len(x)
    own = rows.selectExpr(*keys, *[f"double(`{f}`) AS _x{i}" for i, f in enumerate(features)], f"double(`{label}`) AS _y").dropna()
    data = cut_lineage(own) if cut else own
    kinds = {k: kind for k, kind in data.dtypes if k in keys}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_b array<double>"])
    z = " + ".join(f"coalesce(_b[{i}], 0D) * {v}" for i, v in enumerate(x))
    sums = [F.expr("sum(greatest(_z, 0D) + ln(1 + exp(-abs(_z))) - _y * _z)").alias("loss")]
    sums += [F.expr(f"sum((_s - _y) * {x[i]})").alias(f"g{i}") for i in range(d)]
    sums += [F.expr(f"sum(_s * (1 - _s) * {x[i]} * {x[j]})").alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
    penalty = np.diag([0.0] + [1.0 / c] * (d - 1))
    at: dict[tuple, np.ndarray] = {}
    tried: dict[tuple, np.ndarray] = {}
    best: dict[tuple, float] = {}
    for _ in range(STEPS):
        table = spark.createDataFrame([(*k, b.tolist()) for k, b in tried.items()], schema)
        # the table comes from the driver, one row per group; shuffled, all rows of a group would meet in one task
        stepped = data.join(F.broadcast(table), list(keys), "left").withColumn("_z", F.expr(z)).withColumn("_s", F.expr("1 / (1 + exp(-_z))"))
        moved = False
        for row in stepped.groupBy(*keys).agg(*sums).collect():  # one row per group
            k = tuple(row[key] for key in keys)
            b = tried.get(k, np.zeros(d))
            loss = row["loss"] + 0.5 * float(b @ penalty @ b)
            if k in at and loss > best[k] + 1e-9 * abs(best[k]):  # too far: half way back
                tried[k] = (at[k] + b) / 2
                moved = True
                continue
            at[k], best[k] = b, loss
            gradient = np.array([row[f"g{i}"] for i in range(d)]) + penalty @ b
            curve = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + penalty
            step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
            tried[k] = b - step
            moved |= bool(np.abs(step).max() > TOLERANCE)
        if not moved:
            break
    found = [(*k, float(b[0]), b[1:].tolist()) for k, b in tried.items()]
    return spark.createDataFrame(found, schema.replace("_b array<double>", "intercept double, weights array<double>"))


def linear(intercept: float, weights: Sequence[float], columns: Sequence[str]) -> str:
    """SQL text of the probability of a fitted row."""
    total = " + ".join([num(intercept), *[f"{num(w)} * {c}" for w, c in zip(weights, columns)]])
    return f"1 / (1 + exp(-({total})))"

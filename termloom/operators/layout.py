"""Force-directed layout of small pruned graphs, one graph a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LAYOUT

#: Link distance, collision radius, charge, centre, decays.
DISTANCE, RADIUS, CHARGE, CENTRE, ALPHA_DECAY, VELOCITY_DECAY = 8.0, 12.0, -1.0, 50.0, 0.05, 0.5


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    ids = sorted(set(rows["source"]) | set(rows["target"]))
    at = {x: k for k, x in enumerate(ids)}
    term = rows["term"].iloc[0]
    pin = at.get(term)
    n = len(ids)
    turn = np.arange(n) * np.pi * (3 - 5**0.5)
    p = CENTRE + 10 * np.sqrt(0.5 + np.arange(n))[:, None] * np.stack([np.cos(turn), np.sin(turn)], 1)
    v = np.zeros_like(p)
    s, t = rows["source"].map(at).to_numpy(), rows["target"].map(at).to_numpy()
    degree = np.bincount(np.concatenate([s, t]), minlength=n)
    alpha = 1.0
    while alpha > 0.001:
        alpha -= alpha * ALPHA_DECAY
        d = p[t] + v[t] - p[s] - v[s]
        length = np.maximum(np.sqrt((d**2).sum(1)), 1e-6)
        pull = d * ((length - DISTANCE) / length * alpha / np.minimum(degree[s], degree[t]))[:, None]
        share = (degree[s] / (degree[s] + degree[t]))[:, None]
        np.add.at(v, t, -pull * share)
        np.add.at(v, s, pull * (1 - share))
        gap = p[:, None] - p[None]
        square = np.maximum((gap**2).sum(2), 1e-6)
        v -= (gap * (CHARGE * alpha / square)[..., None]).sum(1)
        near = np.sqrt(square)
        push = np.where((near < 2 * RADIUS) & ~np.eye(n, dtype=bool), (2 * RADIUS - near) / near * 0.5, 0)
        v += (gap * push[..., None]).sum(1) * 0.5
        v *= 1 - VELOCITY_DECAY
        p += v
        p += CENTRE - p.mean(0)
        if pin is not None:
            p[pin], v[pin] = CENTRE, 0
    return pd.DataFrame({"graph_id": rows["graph_id"].iloc[0], "id": ids, "x": p[:, 0], "y": p[:, 1], "pinned": [x == term for x in ids]})


def layout(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(graph_id, id, x, y, pinned) in a 0 to 100 space; the term is pinned to its centre. For
    pruned graphs, whose size is bounded by max_nodes."""
    rows = edges.join(terms.select("graph_id", F.col("term")), "graph_id", "left").select("graph_id", "source", "target", "term")
    return rows.groupBy("graph_id").applyInPandas(_solve, LAYOUT)

"""Correlation clusters and hierarchical risk parity: one small matrix per rebalance date, so grouped pandas functions over NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .portfolio import top_n


def distances(returns: np.ndarray) -> np.ndarray:
    """sqrt((1 - correlation) / 2); a column without variance correlates with nothing."""
    x = returns - returns.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    flat = norm == 0
    rho = (x / np.where(flat, 1, norm)).T @ (x / np.where(flat, 1, norm))
    d = np.sqrt(np.clip((1 - rho) / 2, 0, 1))
    np.fill_diagonal(d, 0)
    return d


def agglomerate(d: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """Merges of the nearest clusters, in order: (a, b, height); the merge t makes cluster n + t. Average or single linkage by updating a distance matrix."""
    n = len(d)
    m = d.astype(float).copy()
    np.fill_diagonal(m, np.inf)
    name, size, merges = list(range(n)), [1] * n, []
    alive = np.ones(n, bool)
    for t in range(n - 1):
        k = int(np.argmin(np.where(alive[:, None] & alive[None, :], m, np.inf)))
        i, j = sorted(divmod(k, n))
        a, b = sorted((name[i], name[j]))
        merges.append((a, b, float(m[i, j])))
        mixed = np.minimum(m[i], m[j]) if linkage == "single" else (size[i] * m[i] + size[j] * m[j]) / (size[i] + size[j])
        m[i], m[:, i] = mixed, mixed
        m[i, i] = np.inf
        alive[j] = False
        name[i], size[i] = n + t, size[i] + size[j]
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, clusters: int) -> np.ndarray:
    """Cluster numbers from 1 after undoing the last merges, and all merges of the same height as an undone one."""
    if clusters >= n:
        return np.arange(1, n + 1)
    limit = sorted((h for *_, h in merges), reverse=True)[clusters - 2] if clusters > 1 else np.inf
    parent = list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for t, (a, b, h) in enumerate(merges):
        if h < limit:
            parent[find(a)] = parent[find(b)] = n + t
    roots = [find(k) for k in range(n)]
    order = {r: c for c, r in enumerate(dict.fromkeys(roots), 1)}
    return np.array([order[r] for r in roots])


def leaves(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """The order of the tree's leaves."""
    if n == 1:
        return [0]
    out, todo = [], [n + len(merges) - 1]
    while todo:
        x = todo.pop()
        if x < n:
            out.append(x)
        else:
            a, b, _ = merges[x - n]
            todo += [b, a]
    return out


def hrp(returns: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity of complete columns: single linkage, then risk split between the halves of the leaf order, level by level."""
    n = returns.shape[1]
    if n == 1:
        return np.ones(1)
    cov = np.cov(returns.T, ddof=1)
    order = leaves(agglomerate(distances(returns), "single"), n)

    def risk(part: list[int]) -> float:
        v = np.diag(cov)[part]
        w = 1 / np.where(v > 0, v, np.inf) if (v > 0).any() else np.ones(len(part))
        w = w / w.sum()
        return float(w @ cov[np.ix_(part, part)] @ w)

    weights, todo = np.ones(n), [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a, b = risk(left), risk(right)
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        weights[left] *= share
        weights[right] *= 1 - share
        todo += [left, right]
    weights = np.clip(weights, 0, None)
    return weights / weights.sum()


def _result(rebal, tickers, name: str, values, kind: str) -> pd.DataFrame:
    """A group's rows; also with the right types where there are none."""
    n = len(tickers)
    return pd.DataFrame({"rebal": pd.Series([rebal] * n, dtype=object), "ticker": pd.Series([str(t) for t in tickers], dtype=object), name: pd.Series(np.asarray(values, dtype=kind), dtype=kind)})


def _wide(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.pivot_table(index="date", columns="ticker", values="ret", aggfunc="first", dropna=False).sort_index(axis=1)


def correlation_clusters(held: DataFrame, clusters: int = 10, least: int = 60) -> DataFrame:
    """(rebal, ticker, cluster) of windows (rebal, ticker, date, ret). Names with too few returns go; fewer names than clusters are one each."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(rows)
        wide = wide.loc[:, wide.count() >= least]
        n = wide.shape[1]
        labels = np.arange(1, n + 1) if n < max(2, clusters) else cut(agglomerate(distances(wide.fillna(0.0).to_numpy()), "average"), n, clusters)
        return _result(rows["rebal"].iloc[0], wide.columns, "cluster", labels, "int32")

    return held.groupBy("rebal").applyInPandas(one, "rebal date, ticker string, cluster int")


def hrp_weights(held: DataFrame) -> DataFrame:
    """(rebal, ticker, w) over the names without a gap."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(rows).dropna(axis=1)
        w = hrp(wide.to_numpy()) if wide.shape[1] and len(wide) > 1 else np.ones(wide.shape[1]) / max(1, wide.shape[1])
        return _result(rows["rebal"].iloc[0], wide.columns, "w", w, "float64")

    return held.groupBy("rebal").applyInPandas(one, "rebal date, ticker string, w double")


def select_and_allocate(bets: DataFrame, held: DataFrame, n: int, least: int = 60) -> DataFrame:
    """The n largest positive bets, weighted by risk parity times bet; equally where history is short or names are few."""
    top = top_n(bets.where(F.col("score") > 0), n).select("rebal", "ticker", "score")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        bet = rows.drop_duplicates("ticker").set_index("ticker")["score"].sort_index()
        wide = _wide(rows).dropna(axis=1)
        if wide.shape[1] < 2 or len(wide) < least:
            w = pd.Series(1.0 / len(bet), index=bet.index)
        else:
            w = pd.Series(hrp(wide.to_numpy()), index=wide.columns) * bet.reindex(wide.columns)
            w = w / w.sum() if w.sum() > 0 else pd.Series(1.0 / len(w), index=w.index)
        return _result(rows["rebal"].iloc[0], w.index, "w", w.to_numpy(), "float64")

    return held.join(top, ["rebal", "ticker"]).groupBy("rebal").applyInPandas(one, "rebal date, ticker string, w double")

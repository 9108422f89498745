"""Numpy kernels of the packed plans: weighted counts of state pairs by one-hot products, and MI from counts."""

from __future__ import annotations

import numpy as np

SLICE = 8192  # samples in a one-hot matrix
DENSE = 8  # a block with one asked pair in so many takes the product of the whole block
AT_ONCE = 1 << 22  # cells of asked pairs that are counted at once


def one_hot(x: np.ndarray, n_states: int) -> np.ndarray:
    """(state, row) by sample."""
    return (x[None] == np.arange(n_states, dtype=x.dtype)[:, None, None]).reshape(n_states * len(x), -1).astype(np.float64)


def block_counts(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, n_states: int) -> np.ndarray:
    """Weighted counts (state of x, state of y, row of x, row of y), by one product for each ``SLICE`` of the samples."""
    out = np.zeros((n_states * len(x), n_states * len(y)))
    for lo in range(0, x.shape[1], SLICE):
        hot = one_hot(x[:, lo : lo + SLICE], n_states)
        if w is not None:
            hot *= w[lo : lo + SLICE]
        out += hot @ one_hot(y[:, lo : lo + SLICE], n_states).T
    return out.reshape(n_states, len(x), n_states, len(y)).transpose(0, 2, 1, 3)


def pair_counts(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray | None, n_states: int) -> np.ndarray:
    """Weighted counts (state of x, state of y, pair) of rows ``u`` of x with rows ``v`` of y: whole chunks of pairs in one
    ``bincount``."""
    cells, step = n_states * n_states, max(1, AT_ONCE // max(1, x.shape[1]))
    out = np.zeros((len(u), cells))
    for lo in range(0, len(u), step):
        a, b = u[lo : lo + step], v[lo : lo + step]
        code = x[a].astype(np.int32) * n_states + y[b] + np.arange(len(a), dtype=np.int32)[:, None] * cells
        weight = None if w is None else np.broadcast_to(w, code.shape)
        if not (met := (x[a] >= 0) & (y[b] >= 0)).all():  # samples that lack a locus
            code, weight = code[met], None if w is None else weight[met]
        out[lo : lo + step] = np.bincount(code.ravel(), None if w is None else weight.ravel(), len(a) * cells).reshape(-1, cells)
    return out.T.reshape(n_states, n_states, -1)


def listed_counts(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray | None, n_states: int, block: int) -> np.ndarray:
    """As ``pair_counts``; blocks of which many pairs are asked are multiplied whole."""
    out = np.empty((n_states, n_states, len(u)))
    cell = (u // block) * (len(y) // block + 1) + v // block
    order = np.argsort(cell, kind="stable")
    cut = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1], True]) if len(u) else np.zeros(1, np.int64)
    few = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        at = order[lo:hi]
        p, q = u[at[0]] // block * block, v[at[0]] // block * block
        bx, by = x[p : p + block], y[q : q + block]
        if len(at) * DENSE >= len(bx) * len(by):
            out[:, :, at] = block_counts(bx, by, w, n_states)[:, :, u[at] - p, v[at] - q]
        else:
            few.append(at)
    if few:
        at = np.concatenate(few)
        out[:, :, at] = pair_counts(x, y, u[at], v[at], w, n_states)
    return out


def presence(x: np.ndarray, n_states: int) -> np.ndarray:
    """(state, row): whether the state occurs in the row."""
    return np.stack([(x == s).any(1) for s in range(n_states)]) if x.size else np.zeros((n_states, len(x)), bool)


def ent(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.where(v > 0, v, 1.0))


def entropies(counts: np.ndarray, here: np.ndarray, alpha: float) -> np.ndarray:
    """MI from counts (state, state, ...); ``here`` marks the cells that get the pseudocount."""
    p = np.where(here, counts + alpha, 0.0)
    z = p.sum((0, 1))
    p /= np.where(z == 0, 1.0, z)
    return ent(p).sum((0, 1)) - ent(p.sum(1)).sum(0) - ent(p.sum(0)).sum(0)


def without_gaps(counts: np.ndarray, here: np.ndarray, alpha: float, gap: int, mode: str) -> np.ndarray:
    """MI without gaps from counts of all states. ``clean`` leaves out samples with a gap at either locus and starts again.
    ``literal`` goes over the table of shares, pseudocounts in it, a second time: the pseudocount is added once more where no
    gap is, shares are normalised by the cells without gaps, and the second locus's marginal keeps the first one's gaps."""
    if mode == "clean":
        rest = [s for s in range(len(counts)) if s != gap]
        return entropies(counts[np.ix_(rest, rest)], here[np.ix_(rest, rest)], alpha)
    p = np.where(here, counts + alpha, 0.0)
    z = p.sum((0, 1))
    p /= np.where(z == 0, 1.0, z)
    free = here.copy()
    free[gap] = free[:, gap] = False
    q = np.where(free, p + alpha, 0.0)
    z = q.sum((0, 1))
    z = np.where(z == 0, 1.0, z)
    second = (q.sum(0) + p[gap]) / z
    second[gap] = 0.0
    q /= z
    return ent(q).sum((0, 1)) - ent(second).sum(0) - ent(q.sum(1)).sum(0)


def marginal_bound(x_counts: np.ndarray, here: np.ndarray, alpha: float, n_states: int) -> np.ndarray:
    """The most that MI with any other locus can be: the entropy of the locus's shares, with the pseudocounts that a partner of
    all states would bring. Pseudocounts mix in an even share of the states present, which only adds entropy, so this holds
    for partners of fewer states too."""
    p = np.where(here, x_counts + alpha * n_states, 0.0)
    z = p.sum(0)
    return -ent(p / np.where(z == 0, 1.0, z)).sum(0)

"""Exact forward-backward over chains of any length in bounded memory.

With potentials psi(t) (one number a state) and a matrix ``move`` the weight of
a path is start(s0) psi(0, s0) * product of move(s, s') psi(t, s').  Chains are
cut into pieces of ``width`` places, which run side by side.  What a piece does
to a message from its left or right end is a small matrix; products of those
give every piece its exact messages from both sides, so the cuts change nothing.
Pieces are handled in windows of about ``window`` places, so a chain of millions
of places takes no more memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

Potentials = Callable[[int, int], np.ndarray]
#: Steps after which the matrices of pieces are scaled; potentials of e**30 and
#: e**-30 stay within a double for that long.
RESCALE = 8


def cut(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces of all chains, and which pieces open a chain."""
    lengths = np.diff(bounds)
    some = lengths > 0
    starts, lengths = bounds[:-1][some], lengths[some]
    pieces = -(-lengths // width)
    first = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + width * inner
    return np.append(cuts, bounds[-1] if len(bounds) else 0), inner == 0


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces from longest to shortest, and how many run at each step."""
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths[order[0]]) if len(order) else 0
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), "right")


def _windows(cuts: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of pieces of about ``window`` places."""
    i, n = 0, len(cuts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + window, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _levels(begin: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places step by step, those of one step side by side, and the steps'
    bounds among them."""
    step = np.repeat(np.arange(len(running)), running)
    level = np.concatenate([[0], np.cumsum(running)])
    return begin[np.arange(len(step)) - level[step]] + step, level


def _effects(psi: np.ndarray, move: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each piece's matrix, up to a factor: row s is where a unit of weight on
    state s before the piece's first potential ends."""
    k = len(move)
    order, running = _by_length(lengths)
    where, level = _levels(begin[order], running)
    psi = psi[where][:, None, :]
    out = np.eye(k) * psi[: len(order)]
    for t in range(1, len(running)):
        n = running[t]
        x = (out[:n].reshape(-1, k) @ move).reshape(n, k, k)
        np.multiply(x, psi[level[t] : level[t + 1]], out=out[:n])
        if t % RESCALE == 0:
            out[:n] /= out[:n].max(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out / out.max(axis=(1, 2), keepdims=True)
    return back


def _messages(effect: np.ndarray, move: np.ndarray, start: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every piece: weights of the states before its first potential, what
    follows its last place, and what follows from its first state on."""
    n, k = len(head), len(move)
    prior, after, ahead = np.empty((n, k)), np.ones((n, k)), np.ones((n, k))
    heads = np.flatnonzero(head)
    pieces = np.diff(np.append(heads, n))
    order, running = _by_length(pieces)
    heads = heads[order]
    prior[heads] = start
    for j in range(1, len(running)):
        at = heads[: running[j]] + j
        prior[at] = _unit(_unit(np.einsum("ni,nij->nj", prior[at - 1], effect[at - 1])) @ move)
    for j in range(len(running) - 1, -1, -1):
        at = heads[: running[j]] + j
        ahead[at] = _unit(np.einsum("nij,nj->ni", effect[at], after[at]))
        if j:
            after[at - 1] = _unit(ahead[at] @ move.T)
    return prior, after, ahead


def expected(psi: Potentials, move: np.ndarray, start: np.ndarray, bounds: np.ndarray, use: Callable[[np.ndarray, np.ndarray], None], width: int = 1024, window: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected counts of first states and of moves, and the log of the total
    weight of all chains (sum of logs).  ``psi(lo, hi)`` gives the potentials
    of those places; ``use(places, p)`` gets the states' probabilities there."""
    k = len(move)
    cuts, head = cut(bounds, width)
    n = len(head)
    firsts, moves, log = np.zeros(k), np.zeros((k, k)), 0.0
    if not n:
        return firsts, moves, log
    prior, after, ahead = np.broadcast_to(start, (n, k)), np.ones((n, k)), None
    inner = ~head
    many = inner.copy()  # pieces of chains that were cut
    many[:-1] |= inner[1:]
    if many.any():
        effect = np.empty((int(many.sum()), k, k))
        place = np.cumsum(many) - 1
        for i, j in _windows(cuts, window):
            here = np.flatnonzero(many[i:j]) + i
            if len(here):
                effect[place[here]] = _effects(psi(int(cuts[i]), int(cuts[j])), move, cuts[here] - cuts[i], cuts[here + 1] - cuts[here])
        prior, ahead = np.array(prior), np.ones((n, k))
        prior[many], after[many], ahead[many] = _messages(effect, move, start, head[many])
    ends = np.empty((n, k))
    for i, j in _windows(cuts, window):
        lo = int(cuts[i])
        order, running = _by_length(np.diff(cuts[i : j + 1]))
        where, level = _levels((cuts[i:j] - lo)[order], running)
        here = psi(lo, int(cuts[j]))[where]
        alpha, scale = np.empty_like(here), np.empty((len(here), 1))
        state = prior[i:j][order]
        for t, m in enumerate(running):
            a, b = level[t], level[t + 1]
            step = (state[:m] @ move if t else state) * here[a:b]
            np.sum(step, axis=1, keepdims=True, out=scale[a:b])
            state = np.divide(step, scale[a:b], out=alpha[a:b])
            stop = running[t + 1] if t + 1 < len(running) else 0
            ends[i + order[stop:m]] = state[stop:m]
        log += float(np.log(scale).sum())
        beta = after[i:j][order]
        beta = beta / (ends[i + order] * beta).sum(axis=1, keepdims=True)
        here /= scale
        for t in range(len(running) - 1, -1, -1):
            a, b, m = level[t], level[t + 1], running[t]
            back = here[a:b] * beta[:m]
            if t:
                moves += alpha[a - running[t - 1] : a - running[t - 1] + m].T @ back
            here[a:b] = beta[:m]
            if t:
                beta[:m] = back @ move.T
        here *= alpha
        firsts += here[: level[1]][head[i:j][order]].sum(axis=0)
        use(lo + where, here)
    moves *= move
    if ahead is not None:
        at = np.flatnonzero(inner)
        joint = ends[at - 1][:, :, None] * move[None] * ahead[at][:, None, :]
        moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return firsts, moves, log

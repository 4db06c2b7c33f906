"""Rounds of a full k-means fit over rows held in memory.

A round gives each row its nearest centre and each centre the mean of its rows. A row is only compared
again when the moves of the centres since its last comparison could have brought another one nearer: its
distance to its own centre may have grown by that centre's moves, the distance to any other may have
shrunk by the largest move among those. Doubtful rows are compared, so the places are those of
comparing all rows in every round.
"""

from __future__ import annotations

import numpy as np

#: Rows compared at a time.
ROWS = 2048
#: Distances nearer to each other than this share of the longest row are compared, not taken from bounds.
DOUBT = 1e-6
#: Sums of the centres follow the rows that move; after so many rounds they are made anew.
RENEW = 25


def _sums(rows: np.ndarray, picks: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each centre."""
    out = np.zeros((k, rows.shape[1]))
    for low in range(0, len(rows), ROWS):
        part = picks[low : low + ROWS]
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        out[part[order[first]]] += np.add.reduceat(rows[low : low + ROWS][order], first)
    return out


def settle(rows: np.ndarray, centres: np.ndarray, max_iter: int, least_move: float) -> np.ndarray:
    """The centres once none moves farther than ``least_move``, or after ``max_iter`` rounds."""
    k, own = len(centres), np.einsum("ij,ij->i", rows, rows)
    doubt = DOUBT * np.sqrt(own.max(initial=0.0))
    picks = np.zeros(len(rows), np.intp)
    mine, other = np.full(len(rows), np.inf), np.zeros(len(rows))
    for turn in range(max_iter):
        # A number that is not one leaves the row in doubt.
        ask = np.flatnonzero(~(mine + doubt < other))
        length, turned = (centres * centres).sum(axis=1), np.ascontiguousarray(-2.0 * centres.T)
        moved, left = [], []
        for low in range(0, len(ask), ROWS):
            at = ask[low : low + ROWS]
            apart = rows[at] @ turned
            apart += length
            pick, each = apart.argmin(axis=1), np.arange(len(at))
            mine[at] = np.sqrt(np.maximum(0.0, own[at] + apart[each, pick]))
            apart[each, pick] = np.inf
            other[at] = np.sqrt(np.maximum(0.0, own[at] + apart.min(axis=1)))
            new = pick != picks[at]
            moved.append(at[new])
            left.append(picks[at[new]])
            picks[at] = pick
        if turn % RENEW == 0:
            n, total = np.bincount(picks, minlength=k), _sums(rows, picks, k)
        elif moved:
            at, was = np.concatenate(moved), np.concatenate(left)
            n += np.bincount(picks[at], minlength=k) - np.bincount(was, minlength=k)
            for low in range(0, len(at), ROWS):
                part, some = rows[at[low : low + ROWS]], slice(low, low + ROWS)
                total += _sums(part, picks[at[some]], k) - _sums(part, was[some], k)
        fed = n > 0
        before, centres = centres, centres.copy()
        centres[fed] = total[fed] / n[fed, None]
        moves = np.sqrt(((centres - before) ** 2).sum(axis=1))
        if not moves.max() > least_move:
            break
        mine += moves[picks]
        most = int(moves.argmax())
        other -= np.where(picks == most, np.delete(moves, most).max(initial=0.0), moves[most])
    return centres

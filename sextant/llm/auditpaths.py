"""Least repairs of role sequences: cost DP over (row, state), then prefix doubling over the arcs that cost least.

States: nothing yet, after a system turn, after a user turn, after an assistant turn; the first and the last may end. A row
is kept, given the role that is due, or deleted; before it turns may be inserted. Everything works on many sequences at
once, laid end to end; a sequence can be a stretch of a longer one, with the costs to go at its end given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTERS = "DIKR"
D, I, K, R = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state after the turn that is due; by initial (none, s, u, a) the state after a kept row, -1 where it isn't due.
DUE = np.array([2, 2, 3, 2])
KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
FAR = 1 << 50
#: What is left to pay, and to insert, where no row follows.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
TAILS = ("", "II", "I", "")


def _row_costs() -> np.ndarray:
    """[initial, forced or 1 + truncated, state before, state after], with insertions before the row."""
    inserts = np.full((4, 4), FAR)
    for q in range(4):
        inserts[q, q] = 0
        once = DUE[q]
        inserts[q, once] = min(inserts[q, once], INSERT)
        inserts[q, DUE[once]] = min(inserts[q, DUE[once]], 2 * INSERT)
    out = np.full((4, 3, 4, 4), FAR)
    for initial in range(4):
        for kind in range(3):
            step = np.full((4, 4), FAR)
            for q in range(4):
                step[q, q] = DELETE
                if kind:
                    more = TRUNCATED * (kind - 1)
                    step[q, DUE[q]] = min(step[q, DUE[q]], REROLE + more)
                    if KEPT[initial, q] >= 0:
                        step[q, KEPT[initial, q]] = min(step[q, KEPT[initial, q]], KEEP + more)
            out[initial, kind] = min_plus(inserts[None], step[None])[0]
    return np.minimum(out, FAR)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR)


ROW_COSTS = _row_costs()


@dataclass
class Rows:
    """Rows of sequences: ``first[k]`` to ``first[k + 1]`` are the k-th's. kind: 0 must go, 1 sound, 2 truncated;
    extra: how many equal rows follow that must go."""

    initial: np.ndarray
    kind: np.ndarray
    extra: np.ndarray
    first: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def costs(self) -> np.ndarray:
        """(rows, 4, 4): least costs from the state before each row to the one at its sequence's end, by doubled steps."""
        total = np.minimum(ROW_COSTS[self.initial, self.kind] + (DELETE * self.extra)[:, None, None], FAR)
        last = self.first[1:][self.of] - 1
        at, jump, longest = np.arange(len(total)), 1, int(np.diff(self.first).max(initial=0))
        while jump < longest:
            far = at[at + jump <= last]
            total[far] = min_plus(total[far], total[far + jump])
            jump *= 2
        return total


class Paths:
    """The least audits of sequences whose costs to go at their ends are ``exits`` (sequences, 4).

    Nodes are (row, state), then (sequence's end, state). Arcs that cost least are kept. Nodes are ranked by their least
    audit of one letter, then of 2, 4, 8 ... by the pair of their own rank and that of the node that their pointer, doubled
    each time, leads to. With full ranks each node takes the arc of the least (letter, rank of its target); a path is laid
    out by doubling these pointers. Arcs of a node have different letters, and no least audit is the start of another.
    """

    def __init__(self, rows: Rows, exits: np.ndarray):
        self.rows, n, sequences = rows, len(rows.initial), len(rows.first) - 1
        self.ends = n * 4
        of = rows.of
        to_go = np.minimum((rows.costs() + exits[of][:, None, :]).min(axis=2), FAR)
        self.value = np.concatenate([to_go.reshape(-1), exits.reshape(-1)])
        row, state = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
        after = np.where(np.arange(n) + 1 < rows.first[1:][of], np.arange(n) + 1, n + of)[row]
        kind, extra, kept = rows.kind[row], DELETE * rows.extra[row], KEPT[rows.initial[row], state]
        may, more = kind > 0, TRUNCATED * (kind == 2)
        targets = np.stack([after * 4 + state, row * 4 + DUE[state], after * 4 + np.maximum(kept, 0), after * 4 + DUE[state]])
        costs = np.stack([DELETE + extra, np.full(n * 4, INSERT), np.where(may & (kept >= 0), KEEP + more + extra, FAR), np.where(may, REROLE + more + extra, FAR)])
        best = costs + self.value[targets] == self.value[: self.ends]
        self.start = np.where(np.diff(rows.first) > 0, rows.first[:-1], n + np.arange(sequences)) * 4
        rank = self._ranks(best, targets)
        weight = np.where(best, np.arange(4)[:, None] * (int(rank.max(initial=0)) + 1) + rank[targets], FAR)
        self.letter = weight.argmin(axis=0) if n else np.zeros(0, np.int64)
        self.next = self._pointers(targets, self.letter)

    def _pointers(self, targets: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return np.concatenate([np.take_along_axis(targets, letter[None], axis=0)[0], np.arange(self.ends, len(self.value))])

    def _ranks(self, best: np.ndarray, targets: np.ndarray) -> np.ndarray:
        least = best.argmax(axis=0)
        rank = np.concatenate([least + 1, np.zeros(len(self.value) - self.ends, np.int64)])
        pointer = self._pointers(targets, least)
        while (pointer < self.ends).any():
            _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
            pointer = pointer[pointer]
        return rank

    def follow(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each sequence's start in ``states``: (sequence, node) of every step in order, and the states at the ends."""
        nodes, of = self.start + states, np.arange(len(states))
        depth, ahead, step = np.zeros(len(nodes), np.int64), self.next, 1
        last = nodes
        while True:
            far = ahead[nodes]
            go = far < self.ends
            last = ahead[last]
            if not go.any():
                break
            nodes, of, depth = np.concatenate([nodes, far[go]]), np.concatenate([of, of[go]]), np.concatenate([depth, depth[go] + step])
            ahead, step = ahead[ahead], step * 2
        while (last < self.ends).any():
            last = ahead[last]
        within = nodes < self.ends
        order = np.lexsort((depth[within], of[within]))
        return of[within][order], nodes[within][order], last % 4

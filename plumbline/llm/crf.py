"""A linear-chain conditional random field in numpy: batched training, batched Viterbi.

A token is known by its type only (a word shape or a cue word). The score of a
label at a token sums the weights of the features of its own type and of
the types before and after it, and of the step from the label before.
"""

from __future__ import annotations

import numpy as np

#: Where a token stands as seen from the label: itself, the one before, the one after.
SIDES = 3


class FeatureSpace:
    """Numbers for features and, for every type met, the list of its feature numbers."""

    def __init__(self, features_of):
        self.features_of = features_of
        self.numbers: dict[str, int] = {}

    def known(self, kind: str, grow: bool = False) -> list[int]:
        names = self.features_of(kind)
        if grow:
            return [self.numbers.setdefault(f, len(self.numbers)) for f in names]
        return [self.numbers[f] for f in names if f in self.numbers]


class Crf:
    """weights: (features, SIDES, labels); steps: (labels, labels), from the label before to the label."""

    def __init__(self, space: FeatureSpace, labels: int, weights: np.ndarray, steps: np.ndarray):
        self.space, self.labels, self.weights, self.steps = space, labels, weights, steps

    def type_scores(self, kind: str) -> np.ndarray:
        """(SIDES, labels) for one type; features never seen in training count nothing."""
        own = self.space.known(kind)
        return self.weights[own].sum(axis=0) if own else np.zeros((SIDES, self.labels), np.float32)

    @classmethod
    def fit(cls, rows: list[tuple[list[str], list[int]]], features_of, labels: int, edge: str, rounds: int = 200, penalty: float = 0.02) -> Crf:
        """From rows of types and labels, by gradient steps on the penalised likelihood; ``edge`` is the type beyond both ends."""
        space = FeatureSpace(features_of)
        width = max(len(t) for t, _ in rows)
        kinds = {k: i for i, k in enumerate(dict.fromkeys([edge, *(t for types, _ in rows for t in types)]))}
        own = [space.known(k, grow=True) for k in kinds]
        design = np.zeros((len(kinds), len(space.numbers)))
        for i, f in enumerate(own):
            design[i, f] = 1
        types = np.full((len(rows), width + 2), 0)
        truth, there = np.zeros((len(rows), width), int), np.zeros((len(rows), width), bool)
        for r, (row, tags) in enumerate(rows):
            types[r, 1 : len(row) + 1] = [kinds[k] for k in row]
            truth[r, : len(row)], there[r, : len(row)] = tags, True
        views = [types[:, 1:-1], types[:, :-2], types[:, 2:]]
        target_steps = np.zeros((labels, labels))
        both = there[:, 1:]
        np.add.at(target_steps, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        one_hot = np.eye(labels)[truth] * there[..., None]
        weights, steps = np.zeros((design.shape[1], SIDES, labels)), np.zeros((labels, labels))
        seen = [np.zeros_like(weights), np.zeros_like(steps)]
        for _ in range(rounds):
            by_type = np.einsum("tf,fsl->tsl", design, weights)
            scores = sum(by_type[v, s] for s, v in enumerate(views))
            marginal, pairs = _marginals(scores, steps, there)
            off = one_hot - marginal
            gradient = np.zeros((len(kinds), SIDES, labels))
            for s, v in enumerate(views):
                np.add.at(gradient[:, s], v[there], off[there])
            for value, slope, mean in ((weights, np.einsum("tf,tsl->fsl", design, gradient) - penalty * weights, seen[0]), (steps, target_steps - pairs - penalty * steps, seen[1])):
                mean += slope * slope
                value += 0.3 * slope / np.sqrt(mean + 1e-8)
        return cls(space, labels, weights.astype(np.float32), steps.astype(np.float32))

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of each row; scores: (rows, places, labels)."""
        rows, width, labels = scores.shape
        back = np.empty((width, rows, labels), np.int8)
        best = scores[:, 0].copy()
        for t in range(1, width):
            step = best[:, :, None] + self.steps
            back[t] = step.argmax(axis=1)
            best = np.take_along_axis(step, back[t][:, None, :].astype(np.intp), 1)[:, 0] + scores[:, t]
        out = np.empty((rows, width), np.int8)
        out[:, -1] = best.argmax(axis=1)
        each = np.arange(rows)
        for t in range(width - 1, 0, -1):
            out[:, t - 1] = back[t][each, out[:, t]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _marginals(scores: np.ndarray, steps: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label at each place, and expected counts of each step."""
    rows, width, labels = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, width):
        ahead[:, t] = np.where(there[:, t, None], _log_sum(ahead[:, t - 1, :, None] + steps, 1) + scores[:, t], ahead[:, t - 1])
    for t in range(width - 2, -1, -1):
        inner = _log_sum(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(there[:, t + 1, None], inner, 0)
    whole = _log_sum(ahead[:, -1], 1)
    marginal = np.exp(ahead + behind - whole[:, None, None]) * there[..., None]
    pairs = np.zeros((labels, labels))
    for t in range(1, width):
        p = np.exp(ahead[:, t - 1, :, None] + steps + (scores[:, t] + behind[:, t])[:, None, :] - whole[:, None, None])
        pairs += p[there[:, t]].sum(axis=0)
    return marginal, pairs

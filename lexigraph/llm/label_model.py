"""A generative model of votes: how right is each voter, and which votes go together.

The model has one hidden true label per candidate and, for either label, a tree
of votes: each vote depends on the label and on one other vote, the one it
shares most information with beyond the label. It is learned by expectation
maximisation from the counts of vote patterns, whose number is bounded by the
grades of the voters whatever the number of candidates.

A vote has a direction (for, against, none) and a grade. The tree is one of the
directions; given direction and label, the grades of different voters are taken
as independent, and are learned once the labels are.
"""

from __future__ import annotations

import numpy as np


def _joint(votes: np.ndarray, weight: np.ndarray, i: int, j: int) -> np.ndarray:
    table = np.full((3, 3), 0.05)
    np.add.at(table, (votes[:, i], votes[:, j]), weight)
    return table / table.sum()


def _parents(votes: np.ndarray, weights: list[np.ndarray]) -> list[int]:
    """Each voter's parent in the tree of largest conditional mutual information; -1 for the root."""
    m = votes.shape[1]
    total = sum(w.sum() for w in weights)
    shared = np.zeros((m, m))
    for i in range(m):
        for j in range(i):
            for w in weights:
                p = _joint(votes, w, i, j)
                independent = np.outer(p.sum(axis=1), p.sum(axis=0))
                shared[i, j] += w.sum() / total * float((p * np.log(p / independent)).sum())
            shared[j, i] = shared[i, j]
    parents, inside = [-1] * m, [0]
    while len(inside) < m:
        _, child, parent = max(
            (shared[c, p], c, p) for c in range(m) if c not in inside for p in inside
        )
        parents[child] = parent
        inside.append(child)
    return parents


def _log_likelihood(votes: np.ndarray, weight: np.ndarray, parents: list[int]) -> np.ndarray:
    result = np.zeros(len(votes))
    for i, parent in enumerate(parents):
        if parent < 0:
            p = np.bincount(votes[:, i], weight, minlength=3) + 0.5
            result += np.log(p / p.sum())[votes[:, i]]
        else:
            table = np.full((3, 3), 0.5)
            np.add.at(table, (votes[:, parent], votes[:, i]), weight)
            table /= table.sum(axis=1, keepdims=True)
            result += np.log(table)[votes[:, parent], votes[:, i]]
    return result


def _grades(votes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """What the grades add to the log odds of each pattern, given the directions of its votes."""
    result = np.zeros(len(votes))
    for vote in votes.T:
        for direction in (-1, 1):
            own = np.sign(vote) == direction
            kinds, kind = np.unique(vote[own], return_inverse=True)
            for w, sign in zip(weights, (1, -1), strict=True):
                p = np.bincount(kind, w[own], minlength=len(kinds)) + 0.5
                result[own] += sign * np.log(p / p.sum())[kind]
    return result


def log_odds(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The logarithm of P(label is true) / P(label is false) of each vote pattern.

    votes: patterns x voters, above 0 for, below 0 against, 0 for no vote, and
    the further from 0 the surer; counts: candidates per pattern. The start is a
    soft majority of the votes, which also says which label is which.
    """
    if len(votes) == 0:
        return np.zeros(0)
    directions, counts = np.sign(votes).astype(np.int64), counts.astype(np.float64)
    codes = directions + 1
    odds = 2.0 * (directions.sum(axis=1) - 0.35 * votes.shape[1])
    parents = [-1] * votes.shape[1]
    for step in range(rounds):
        true = 1 / (1 + np.exp(-odds))
        weights = [counts * true, counts * (1 - true)]
        if step in (1, 3, 6, 12, rounds // 2):
            # early, before voters that copy each other have pulled the label to themselves
            parents = _parents(codes, weights)
        prior = np.array([w.sum() + 1 for w in weights])
        prior /= prior.sum()
        yes = np.log(prior[0]) + _log_likelihood(codes, weights[0], parents)
        no = np.log(prior[1]) + _log_likelihood(codes, weights[1], parents)
        odds = np.clip(yes - no, -50, 50)
    true = 1 / (1 + np.exp(-odds))
    return np.clip(odds + _grades(votes, [counts * true, counts * (1 - true)]), -50, 50)


def posteriors(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P(label is true) of each vote pattern."""
    return 1 / (1 + np.exp(-log_odds(votes, counts, rounds)))

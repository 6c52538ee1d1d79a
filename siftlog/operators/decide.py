"""Decisions over class probabilities: column expressions only.

Probabilities are three columns in the order of LABELS. Ties go to the first label in that order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.schema import LABELS

SWAP_COST = 0.5


class Probabilities(Sequence):
    """Three columns in the order of LABELS, made when they are used, so that modules can name them without a session."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __len__(self) -> int:
        return len(LABELS)

    def __getitem__(self, i: int) -> Column:
        return F.col(self.prefix + LABELS[i])


def probabilities(prefix: str = "p_") -> Probabilities:
    return Probabilities(prefix)


def first_best(scores: list[Column], largest: bool = True) -> Column:
    """The label of the largest (or smallest) score, the first of equal ones."""
    best = (F.greatest if largest else F.least)(*scores)
    return reduce(lambda rest, i: F.when(scores[i] == best, LABELS[i]).otherwise(rest), range(len(scores) - 2, -1, -1), F.lit(LABELS[len(scores) - 1]))


def weighted_argmax(p: Probabilities, allowed: Column | None = None, weights: dict[str, float] | None = None) -> Column:
    """The best label by weighted probability among ``allowed`` (an array of labels; empty or null allows all)."""
    scores = [x * F.lit(float((weights or {}).get(label, 1.0))) for label, x in zip(LABELS, p, strict=True)]
    if allowed is not None:
        free = F.coalesce(F.size(F.array_intersect(allowed, F.array(*map(F.lit, LABELS)))) == 0, F.lit(True))
        scores = [F.when(free | F.array_contains(allowed, label), s).otherwise(F.lit(float("-inf"))) for label, s in zip(LABELS, scores, strict=True)]
    return first_best(scores)


def risks(p: Probabilities, miss, swap: float = SWAP_COST, false_alarm: float = 1.0) -> list[Column]:
    """The expected cost of each label; ``miss`` is what a threat called benign costs."""
    benign, suspicious, malicious = p
    miss = miss if isinstance(miss, Column) else F.lit(float(miss))
    return [(suspicious + malicious) * miss, benign * false_alarm + malicious * swap, benign * false_alarm + suspicious * swap]


def min_cost(p: Probabilities, miss) -> Column:
    return first_best(risks(p, miss), largest=False)


def cost_confidence(p: Probabilities, miss) -> Column:
    """r2 / (r1 + r2) of the two smallest costs; 1 if they are zero."""
    r = F.sort_array(F.array(*risks(p, miss)))
    total = F.get(r, F.lit(0)) + F.get(r, F.lit(1))
    return F.when(total > 0, F.get(r, F.lit(1)) / total).otherwise(F.lit(1.0))


def benign_first(p: Probabilities, weight) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return first_best([p[0] * weight, p[1], p[2]])


def decision_confidence(p: Probabilities, weight) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    scores = [p[0] * weight, p[1], p[2]]
    return F.greatest(*scores) / (scores[0] + scores[1] + scores[2])


def alert_type(p: Probabilities) -> Column:
    return F.when(p[1] >= p[2], LABELS[1]).otherwise(LABELS[2])


def one_hot(label: Column) -> tuple[Column, ...]:
    return tuple((label == x).cast("double") for x in LABELS)


def fuse_by_cost(rule: str, param: float, clf: Column, p: Probabilities, llm: Probabilities, m_dec: float) -> Column:
    """The label after a reply with probabilities ``llm``; without one (null) the classifier's label stays."""
    if rule == "raise":
        fused = F.when((clf == LABELS[0]) & (min_cost(llm, param) != LABELS[0]), alert_type(p)).otherwise(clf)
    elif rule in ("gate_km", "mix_km"):
        voted = llm if rule == "gate_km" else tuple((1 - param) * a + param * b for a, b in zip(p, llm, strict=True))
        alert = min_cost(voted, param if rule == "gate_km" else m_dec) != LABELS[0]
        fused = F.when(clf == LABELS[2], LABELS[2]).when(alert, alert_type(p)).otherwise(LABELS[0])
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.when(llm[0].isNull(), clf).otherwise(fused)


def fuse_by_label(rule: str, clf: Column, p: Probabilities, label: Column, llm: Probabilities, weight: float) -> Column:
    """The benign-first rules: what the model's label or probabilities may change of the classifier's label."""
    by_p = benign_first(llm, weight)
    rules = {
        "llm": label,
        "llm_gate": F.when(label == LABELS[0], LABELS[0]).otherwise(alert_type(p)),
        "agree_alert": F.when((label == LABELS[0]) | (clf == LABELS[0]), LABELS[0]).otherwise(clf),
        "llm_prob": by_p,
        "llm_prob_gate": F.when(by_p == LABELS[0], LABELS[0]).otherwise(alert_type(p)),
        "llm_prob_gate_km": F.when(clf == LABELS[2], LABELS[2]).when(by_p == LABELS[0], LABELS[0]).otherwise(alert_type(p)),
    }
    return F.when(label.isNull(), clf).otherwise(rules[rule])

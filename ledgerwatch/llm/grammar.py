"""Weighted finite-state grammar of hostile clauses.

A clause is read as symbols: I insult, H threat, Y target, N negation, R reported speech, w any
other word. Each transducer rewrites symbols one by one with a weight; composed, they turn a
clause into scored events. All are deterministic, so the composition is built state by state.
"""

from __future__ import annotations

from collections.abc import Callable

REACH = 3  # words over which a target or a negation works
NEGATED, REPORTED, AIMED, THREAT = 0.6, 0.7, 1.25, 3.0

State = tuple
Step = Callable[[State, str], tuple[State, str, float]]


def negation(state: State, symbol: str) -> tuple[State, str, float]:
    """An insult or threat within reach after a negation weighs less."""
    (left,) = state
    if symbol == "N":
        return (REACH,), "w", 1.0
    return (max(left - 1, 0),), symbol, NEGATED if left and symbol in "IH" else 1.0


def reported(state: State, symbol: str) -> tuple[State, str, float]:
    """What follows a verb of saying in the clause is another's speech."""
    (inside,) = state
    if symbol == "R":
        return (1,), "w", 1.0
    return (inside,), symbol, REPORTED if inside and symbol in "IH" else 1.0


def target(state: State, symbol: str) -> tuple[State, str, float]:
    """An insult within reach after a target is aimed (A); targets go on for the threats."""
    (left,) = state
    if symbol == "Y":
        return (REACH,), "Y", 1.0
    return (max(left - 1, 0),), ("A" if left and symbol == "I" else symbol), (AIMED if left and symbol == "I" else 1.0)


def threat(state: State, symbol: str) -> tuple[State, str, float]:
    """A threat that meets a target within reach becomes T; alone it is no event."""
    (left,) = state
    if symbol == "H":
        return (REACH,), "w", 1.0
    if left and symbol == "Y":
        return (0,), "T", 1.0
    return (max(left - 1, 0),), symbol, 1.0


def insult(state: State, symbol: str) -> tuple[State, str, float]:
    """Events leave, all else is silent; an insult right after another adds less."""
    (before,) = state
    if symbol in "IA":
        return (1,), "I", 0.8 if before else 1.0
    return (0,), ("T" if symbol == "T" else ""), 1.0


class Composed:
    """Composition of deterministic transducers, with its transitions kept once met."""

    def __init__(self, steps: list[Step]):
        self.steps, self.start = steps, tuple((0,) for _ in steps)
        self.table: dict[tuple[State, str], tuple[State, str, float]] = {}

    def step(self, state: State, symbol: str) -> tuple[State, str, float]:
        found = self.table.get((state, symbol))
        if found is None:
            out, weight, after = symbol, 1.0, []
            for part, own in zip(self.steps, state, strict=True):
                own, out, w = part(own, out or "w")
                after.append(own)
                weight *= w
            found = self.table[state, symbol] = (tuple(after), out, weight)
        return found


GRAMMAR = Composed([negation, reported, target, threat, insult])


def clause_score(symbols: list[tuple[int, str, float]]) -> float:
    """Score of a clause: (word number, symbol, lexical weight) of its marked words, in order.

    A threat takes the weight of its word times THREAT when it finds a target.
    """
    state, total, last, menace = GRAMMAR.start, 0.0, None, 0.0
    for at, symbol, weight in symbols:
        for _ in range(min(at - last - 1, REACH + 1) if last is not None else 0):
            state = GRAMMAR.step(state, "w")[0]
        last = at
        state, event, factor = GRAMMAR.step(state, symbol)
        if symbol == "H":
            menace = weight * factor
        if event:
            total += factor * (THREAT * menace if event == "T" else weight)
    return total

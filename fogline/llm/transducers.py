"""Finite-state transducers over small alphabets of symbols, and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass, field
from functools import reduce

State = Hashable
#: (output, weight, next state)
Arc = tuple[str, float, State]


@dataclass
class Transducer:
    """arcs[state][input] lists the arcs that read input there; a state without an arc for a symbol rejects it."""

    starts: tuple[State, ...]
    arcs: dict[State, dict[str, list[Arc]]] = field(default_factory=dict)
    finals: frozenset[State] = frozenset()

    def inputs(self) -> set[str]:
        return {x for of in self.arcs.values() for x in of}

    def outputs(self) -> set[str]:
        return {o for of in self.arcs.values() for found in of.values() for o, _, _ in found}

    def accept(self, symbols: Iterable[str]) -> list[tuple[list[str], float]]:
        """The outputs and the weight of every path that reads the symbols and ends in a final state."""
        paths: list[tuple[State, list[str], float]] = [(s, [], 0.0) for s in self.starts]
        for x in symbols:
            paths = [(n, [*out, o], w + v) for s, out, w in paths for o, v, n in self.arcs.get(s, {}).get(x, [])]
        return [(out, w) for s, out, w in paths if s in self.finals]


def build(starts: Iterable[State], alphabet: Iterable[str], step: Callable[[State, str], Iterable[Arc]], final: Callable[[State], bool] = lambda s: True) -> Transducer:
    """The transducer whose arcs are step(state, symbol), over the states that its starts reach."""
    starts, alphabet = tuple(starts), tuple(alphabet)
    arcs: dict[State, dict[str, list[Arc]]] = {}
    todo = list(starts)
    while todo:
        s = todo.pop()
        if s in arcs:
            continue
        arcs[s] = {x: found for x in alphabet if (found := list(step(s, x)))}
        todo += [n for found in arcs[s].values() for _, _, n in found]
    return Transducer(starts, arcs, frozenset(s for s in arcs if final(s)))


def compose(*machines: Transducer) -> Transducer:
    """Reads what the first reads and writes what the last writes; each reads its predecessor's outputs, and weights add up.

    Pairs of states from which no final one can be reached are left out.
    """
    return reduce(_composed, machines)


def _composed(a: Transducer, b: Transducer) -> Transducer:
    def step(pair: State, x: str) -> Iterable[Arc]:
        p, q = pair
        for out, w, n in a.arcs[p].get(x, []):
            for last, v, m in b.arcs[q].get(out, []):
                yield last, w + v, (n, m)

    whole = build([(p, q) for p in a.starts for q in b.starts], sorted(a.inputs()), step, lambda s: s[0] in a.finals and s[1] in b.finals)
    alive, grown = set(whole.finals), True
    while grown:
        more = {s for s, of in whole.arcs.items() if s not in alive and any(n in alive for found in of.values() for _, _, n in found)}
        alive |= more
        grown = bool(more)
    arcs = {s: {x: kept for x, found in of.items() if (kept := [arc for arc in found if arc[2] in alive])} for s, of in whole.arcs.items() if s in alive}
    return Transducer(tuple(s for s in whole.starts if s in alive), arcs, whole.finals)

"""Small weighted finite-state transducers: composition and best paths (weights add, best is most).

All machines here read one symbol and write one symbol an arc. A machine may guess: a path whose
guess does not come true ends in a state that is not final.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    """``arcs[state][symbol]``: ``(written, weight, next state)``; state 0 is the start."""

    arcs: list[dict[str, list[tuple[str, float, int]]]] = field(default_factory=list)
    final: set[int] = field(default_factory=set)

    def state(self, final: bool = True) -> int:
        self.arcs.append({})
        if final:
            self.final.add(len(self.arcs) - 1)
        return len(self.arcs) - 1

    def arc(self, at: int, read: str, written: str, to: int, weight: float = 0.0) -> None:
        self.arcs[at].setdefault(read, []).append((written, weight, to))

    def then(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this machine writes."""
        out, number, todo = Transducer(), {}, []

        def place(a: int, b: int) -> int:
            if (a, b) not in number:
                number[a, b] = out.state(a in self.final and b in other.final)
                todo.append((a, b))
            return number[a, b]

        place(0, 0)
        while todo:
            a, b = todo.pop()
            for read, ways in self.arcs[a].items():
                for middle, w, to in ways:
                    for written, v, end in other.arcs[b].get(middle, ()):
                        out.arc(number[a, b], read, written, place(to, end), w + v)
        return out

    def best(self, symbols: list[str], strength: list[float]) -> tuple[float, list[str]] | None:
        """Weight and written symbols of the best path over all of ``symbols``; an arc's weight
        counts ``strength`` times that of its symbol. None where no path ends."""
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for symbol, s in zip(symbols, strength, strict=True):
            after: dict[int, tuple[float, tuple]] = {}
            for state, (total, back) in paths.items():
                for written, weight, to in self.arcs[state].get(symbol, ()):
                    new = total + weight * s
                    if to not in after or new > after[to][0]:
                        after[to] = (new, (written, back))
            paths = after
        ends = [p for state, p in paths.items() if state in self.final]
        if not ends:
            return None
        total, back = max(ends, key=lambda p: p[0])
        out = []
        while back:
            out.append(back[0])
            back = back[1]
        return total, out[::-1]

"""A multi-pattern automaton: a trie with failure links, through which a text passes once for all patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator


class Automaton:
    """Finds every place of every pattern; empty patterns are left out, repeated ones count once."""

    def __init__(self, patterns: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # length of the pattern that ends in the state, 0 for none
        for pattern in patterns:
            state = 0
            for c in pattern:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append(0)
                state = self.goto[state][c]
            self.ends[state] = len(pattern)
        self._link()

    def _link(self) -> None:
        """fail: the longest proper suffix that is a state; shorter: the next such suffix that ends a pattern."""
        self.fail, self.shorter = [0] * len(self.goto), [0] * len(self.goto)
        work = deque(self.goto[0].values())
        while work:
            state = work.popleft()
            for c, following in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[following] = self.goto[back].get(c, 0)
                work.append(following)
            back = self.fail[state]
            self.shorter[state] = back if self.ends[back] else self.shorter[back]
        self.steps = [dict(g) for g in self.goto]  # with what failure links have led to, as it is met

    def _step(self, state: int, c: str) -> int:
        back = state
        while back and c not in self.goto[back]:
            back = self.fail[back]
        self.steps[state][c] = found = self.goto[back].get(c, 0)
        return found

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every pattern in the text, by end, longer ones first."""
        state, steps, ends, shorter = 0, self.steps, self.ends, self.shorter
        for at, c in enumerate(text, 1):
            following = steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if ends[state] or shorter[state]:
                hit = state if ends[state] else shorter[state]
                while hit:
                    yield at - ends[hit], at
                    hit = shorter[hit]

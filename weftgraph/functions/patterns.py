"""Many substrings looked for at once: an automaton over names."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of one automaton.
PART = 50_000


class Automaton:
    """Finds all patterns that a text holds, in one walk over it."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        for pattern in dict.fromkeys(patterns):
            state = 0
            for c in pattern:
                if c not in self.go[state]:
                    self.go[state][c] = len(self.go)
                    self.go.append({})
                    self.ends.append(())
                state = self.go[state][c]
            self.ends[state] += (pattern,)
        self.back = [0] * len(self.go)
        queue = deque(self.go[0].values())
        while queue:
            state = queue.popleft()
            for c, to in self.go[state].items():
                queue.append(to)
                self.back[to] = self._next(self.back[state], c)
                # What ends where the longest proper ending stands, ends here too.
                self.ends[to] += self.ends[self.back[to]]

    def _next(self, state: int, c: str) -> int:
        while state and c not in self.go[state]:
            state = self.back[state]
        return self.go[state].get(c, 0)

    def found(self, text: str) -> set[str]:
        state, out = 0, set(self.ends[0])
        for c in text:
            state = self._next(state, c)
            out.update(self.ends[state])
        return out


def _finder(shared, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for pdf in batches:
            rows = [(text, p) for text in pdf[column] for p in sorted(automaton.found(text.lower()))]
            yield pd.DataFrame(rows, columns=[column, "pattern"])

    return run


def holds_any(texts: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """(column, pattern) for each distinct text and lower-case pattern that it holds, whatever its case. At most `PART` patterns."""
    shared = texts.sparkSession.sparkContext.broadcast(Automaton(patterns))
    return texts.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(_finder(shared, column), f"`{column}` string, pattern string")

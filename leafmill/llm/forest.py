"""Union-find over the ids that one task sees."""

from __future__ import annotations


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were together before; the smaller root stays."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

"""A bounded first-in first-out ring of frames, for stateful operators. It refuses what does not fit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from itertools import islice


class Ring:
    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self._items = capacity, deque()

    def __len__(self) -> int:
        return len(self._items)

    @property
    def free(self) -> int:
        return self.capacity - len(self._items)

    def write(self, items: Iterable) -> int:
        """Append what fits, in order; returns how many did. Nothing is overwritten."""
        before = len(self._items)
        self._items.extend(islice(items, self.free))
        return len(self._items) - before

    def peek(self, n: int) -> list:
        """Up to ``n`` oldest, without taking them; EOFError if empty."""
        if not self._items:
            raise EOFError
        return list(islice(self._items, n))

    def read(self, n: int) -> list:
        out = self.peek(n)
        self.advance(len(out))
        return out

    def advance(self, n: int) -> int:
        """Drop up to ``n`` oldest."""
        n = min(n, len(self._items))
        for _ in range(n):
            self._items.popleft()
        return n

    def reset(self) -> None:
        self._items.clear()

    def adopt(self, items: Iterable) -> None:
        """Take over a list as content; the capacity grows if it must."""
        self._items = deque(items)
        self.capacity = max(self.capacity, len(self._items))

    def kth(self, k: int):
        """k-th oldest, None beyond the end."""
        return self._items[k] if 0 <= k < len(self._items) else None

    def first(self):
        return self.kth(0)

    def last(self):
        return self.kth(len(self._items) - 1)

    def next_place(self, k: int) -> int | None:
        return k + 1 if 0 <= k < len(self._items) - 1 else None

    def previous_place(self, k: int) -> int | None:
        return k - 1 if 0 < k < len(self._items) else None

    def legal_place(self, k: int) -> bool:
        return 0 <= k < len(self._items)

"""A worker's bounded memo of words."""

from __future__ import annotations


class Memo(dict):
    """word -> value, filled by ``fill(missing words)``; emptied when it has grown too large."""

    def __init__(self, fill, limit: int, longest: int = 200):
        super().__init__()
        self.fill, self.limit, self.longest = fill, limit, longest

    def learn(self, words: set[str]) -> None:
        """Make every one of ``words`` available until the next call."""
        if len(self) > self.limit:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            self.update(zip(new, self.fill(new)))

    def forget_long(self, words: set[str]) -> None:
        for w in words:
            if len(w) > self.longest:
                self.pop(w, None)

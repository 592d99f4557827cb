"""Bounded memo for values computed once a word: two generations, so that frequent words are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordMemo(dict):
    """``memo[word]`` computes a missing word by ``compute([word])``; ``fill`` computes many at once.

    Holds at most two generations of ``limit`` words: when the young one is full it becomes the old one, and
    words that are met again move back to the young one.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], limit: int = 150_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.compute([word])[0]
        self[word] = found
        return found

    def fill(self, words: Iterable[str]) -> None:
        """Make room if need be, then compute what is missing of ``words`` in one call."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        missing = []
        for word in words:
            if word not in self:
                found = self.old.get(word)
                if found is None:
                    missing.append(word)
                else:
                    self[word] = found
        if missing:
            self.update(zip(missing, self.compute(missing)))

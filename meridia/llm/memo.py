"""A bounded memory of what was computed for a key, in two generations."""

from __future__ import annotations


class Memo(dict):
    """A dict that computes missing values. When it holds ``limit`` keys these become the old generation, and what is
    asked for again comes back from there, so that frequent keys stay while memory is bounded by 2 * limit keys.
    Values of keys longer than ``longest`` are computed each time: no key holds much memory."""

    def __init__(self, compute, limit: int, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

"""A set of whole numbers whose neighbours are found in a few steps."""

from __future__ import annotations


class Slots:
    """Numbers below ``size`` as bitmaps of 64 bits, each level marking the full words of the one below."""

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while not self.levels or size > 1:
            size = (size + 63) >> 6
            self.levels.append([0] * size)

    def add(self, i: int) -> None:
        for level in self.levels:
            word = level[i >> 6]
            level[i >> 6] = word | 1 << (i & 63)
            if word:
                return
            i >>= 6

    def remove(self, i: int) -> None:
        for level in self.levels:
            word = level[i >> 6] & ~(1 << (i & 63))
            level[i >> 6] = word
            if word:
                return
            i >>= 6

    def before(self, i: int) -> int:
        """The greatest number below ``i``, or -1."""
        for depth, level in enumerate(self.levels):
            low = level[i >> 6] & ((1 << (i & 63)) - 1)
            if low:
                i = (i >> 6 << 6) + low.bit_length() - 1
                for lower in self.levels[:depth][::-1]:
                    i = (i << 6) + lower[i].bit_length() - 1
                return i
            i >>= 6
        return -1

    def after(self, i: int) -> int:
        """The least number above ``i``, or -1."""
        for depth, level in enumerate(self.levels):
            high = level[i >> 6] >> (i & 63) >> 1
            if high:
                i += (high & -high).bit_length()
                for lower in self.levels[:depth][::-1]:
                    i = (i << 6) + (lower[i] & -lower[i]).bit_length() - 1
                return i
            i >>= 6
        return -1

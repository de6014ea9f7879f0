"""A run-length compressed index of short texts that answers which stretches of LENGTH bytes recur.

The texts are put in a row, in ascending order of their documents, and their suffixes are sorted by their first LENGTH
bytes, equal ones by place. The Burrows-Wheeler transform of that order is kept as runs; the smallest document is
sampled where a group of suffixes with LENGTH equal bytes begins. Patterns are matched backwards, all of them in lock step: a
rank over the runs extends a match to the left, and a match of LENGTH bytes is first widened to its first LENGTH - 1. Since
suffixes of equal context are in the order of their documents, the sample at the head of a match is the smallest document
that holds it.
"""

from __future__ import annotations

import numpy as np

LENGTH = 50
#: Between texts: a byte that UTF-8 never has.
STOP = 0xFF


def _ranks(a: np.ndarray, b: np.ndarray | None = None, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) by the pairs (a, b); if ``stable``, ties keep their places."""
    key = a if b is None else (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    order = np.argsort(key, kind="stable" if stable else None)
    k = key[order]
    new = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
    rank = np.empty(len(key), dtype=np.uint32)
    rank[order] = new
    return order, rank


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x shifted by so many places; past the end stands the smallest value."""
    out = np.zeros_like(x)
    out[: len(x) - by] = x[by:] + 1 if len(x) > by else 0
    return out


class RunLengthIndex:
    """Index of ``texts`` (bytes without 0xFF), which are in ascending order of ``docs``, for matches of ``length`` bytes."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> None:
        if not 33 <= length <= 64:
            raise ValueError("length must be 33 to 64")
        self.length = length
        stop = bytes([STOP])
        t = np.frombuffer(stop + stop.join(texts) + stop, dtype=np.uint8)
        n = self.n = len(t)
        padded = np.concatenate((t, np.zeros(8, np.uint8)))
        eight = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | padded[i : n + i]
        rank = _ranks(eight)[1]
        if n < 1 << 21:  # three ranks fit into a key
            three = lambda r, i, j: (r.astype(np.uint64) << np.uint64(42)) | (_ahead(r, i).astype(np.uint64) << np.uint64(21)) | _ahead(r, j)
            rank = _ranks(three(rank, 8, 16))[1]
            known = 24
            order = np.argsort(three(rank, known, length - known), kind="stable")
            middle = _ahead(rank, known)
        else:
            for by in (8, 16):
                rank = _ranks(rank, _ahead(rank, by))[1]
            known = 32
            order, _ = _ranks(rank, _ahead(rank, length - known), stable=True)
            middle = rank
        last, before = _ahead(rank, length - known), _ahead(rank, length - 1 - known)
        # groups of suffixes with so many equal bytes
        new = np.ones(n, bool)
        new[1:] = False
        for r in (rank, middle):
            r = r[order]
            new[1:] |= r[1:] != r[:-1]
        differs = lambda r: np.concatenate(([True], r[order][1:] != r[order][:-1]))
        self.whole = np.flatnonzero(new | differs(last))
        self.short = np.append(np.flatnonzero(new | differs(before)), n)
        self._heads = eight[order]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        owner = np.concatenate(([-1], np.repeat(np.arange(len(texts)), sizes)))
        self.sample = np.asarray(docs)[owner[order[self.whole]]]
        bwt = t[order - 1]
        starts = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        lengths, chars = np.diff(np.append(starts, n)), bwt[starts]
        by_char = np.argsort(chars, kind="stable")
        chars, starts, lengths = chars[by_char].astype(np.int64), starts[by_char], lengths[by_char]
        self.runs = chars * (n + 1) + starts
        self.lengths, total = lengths, np.concatenate(([0], np.cumsum(lengths)))
        counts = np.bincount(t, minlength=256)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        # place of a run's first character in the sorted order: what a step to the left adds up to
        self.target = total[:-1]
        self.starts = starts
        self.n_runs = len(starts)

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of a character's suffixes plus its number before ``lo``, and before ``hi``."""
        base = c * (self.n + 1)
        k = np.searchsorted(self.runs, base + lo, side="left") - 1
        j = k.copy()
        far = np.flatnonzero(self.runs[np.minimum(k + 1, self.n_runs - 1)] < base + hi)  # another run begins before hi
        j[far] = np.searchsorted(self.runs, base[far] + hi[far], side="left") - 1
        out = []
        for at, run in ((lo, k), (hi, j)):
            run = np.maximum(run, 0)
            start = self.starts[run]
            same = self.runs[run] - start == base
            out.append(np.where(same, self.target[run] + np.minimum(at - start, self.lengths[run]), self.first[c]))
        return out[0], out[1]

    def least_documents(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, place, smallest document) of every stretch of ``length`` bytes of the patterns that the index holds.

        Patterns are streamed from their ends. Patterns that the index itself holds never break off; where another one does,
        the match that ends one byte earlier is built up anew.
        """
        sizes = np.fromiter(map(len, patterns), dtype=np.int64, count=len(patterns))
        live = np.flatnonzero(sizes >= self.length)
        data = np.frombuffer(b"".join(patterns), dtype=np.uint8).astype(np.int64)
        end = np.cumsum(sizes)[live]
        begin = end - sizes[live]
        # a match begins with its last eight bytes, looked up among the sorted suffixes' first ones
        eight = np.zeros(len(live), dtype=np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | data[end - 8 + i].astype(np.uint64)
        lo, hi = (np.searchsorted(self._heads, eight, side=s) for s in ("left", "right"))
        found = hi > lo
        got = np.where(found, 8, 0)
        lo, hi = np.where(found, lo, 0), np.where(found, hi, self.n)
        at, out = end - got, []
        while len(live):
            at = at - 1
            full = got >= self.length
            if full.any():  # widen to the context of one byte less
                k = np.searchsorted(self.short, lo[full], side="right") - 1
                lo[full], hi[full] = self.short[k], self.short[k + 1]
                got[full] = self.length - 1
            c = data[at]
            lo, hi = self._step(c, lo, hi)
            got = got + 1
            gone = hi <= lo
            if gone.any():  # no match of this end: the one that ends a byte earlier starts anew
                at[gone] += got[gone] - 1
                lo[gone], hi[gone], got[gone] = 0, self.n, 0
            hit = got >= self.length
            if hit.any():
                k = np.searchsorted(self.whole, lo[hit], side="right") - 1
                out.append(np.stack([live[hit], (at - begin)[hit], self.sample[k]]))
            # a pattern ends where too little is left for another match
            go = (at > begin) & (got + (at - begin) >= self.length)
            live, begin, at, lo, hi, got = live[go], begin[go], at[go], lo[go], hi[go], got[go]
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return found[0], found[1], found[2]

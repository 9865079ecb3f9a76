"""Building patterns from clusters: alignment, ordered merging with edge filling, trimming, expansion, polishing.

A merge changes the pattern that the next seqlet is aligned to, so a cluster is folded in order inside one task; the
clusters run in parallel. The cap on seqlets bounds what a task can hold. Inside a task a pattern is an ordered list of
seqlets (example, start, end, reverse) over the tracks that came with the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Seqlet:
    example: int
    start: int
    end: int
    rc: bool

    @property
    def key(self) -> tuple[int, int, int]:
        return self.example, self.start, self.end

    def moved(self, left: int, right: int) -> Seqlet:
        """Grown by left and right as seen on its own strand (negative: trimmed)."""
        a, b = (right, left) if self.rc else (left, right)
        return Seqlet(self.example, self.start - a, self.end + b, self.rc)

    def flipped(self) -> Seqlet:
        return Seqlet(self.example, self.start, self.end, not self.rc)


class Tracks(dict):
    """example -> (one-hot, hypothetical) arrays [length, 4]."""

    def read(self, s: Seqlet) -> np.ndarray:
        """[3, width, 4]: one-hot, contributions and hypothetical contributions on the seqlet's strand."""
        hot, hyp = (x[s.start : s.end] for x in self[s.example])
        out = np.stack([hot, hot * hyp, hyp])
        return out[:, ::-1, ::-1] if s.rc else out

    def holds(self, s: Seqlet) -> bool:
        return s.start >= 0 and s.end <= len(self[s.example][0])


@dataclass
class Pattern:
    """Seqlets aligned at their left ends, distinct by coordinates; sums are [3, width, 4]."""

    tracks: Tracks
    seqlets: list[Seqlet] = field(default_factory=list)

    def __post_init__(self):
        given, self.seqlets, self.keys, self.sums, self.counts = self.seqlets, [], set(), np.zeros((3, 0, 4)), np.zeros(0)
        for s in given:
            self.add(s)

    def add(self, s: Seqlet) -> None:
        if s.key in self.keys:
            return
        data = self.tracks.read(s)
        width = data.shape[1]
        if width > len(self.counts):
            grow = width - len(self.counts)
            self.sums = np.pad(self.sums, ((0, 0), (0, grow), (0, 0)))
            self.counts = np.pad(self.counts, (0, grow))
        self.sums[:, :width] += data
        self.counts[:width] += 1
        self.seqlets.append(s)
        self.keys.add(s.key)

    def __len__(self) -> int:
        return len(self.counts)

    @property
    def means(self) -> np.ndarray:
        return self.sums / np.maximum(self.counts, 1e-7)[None, :, None]

    def trimmed(self, start: int, end: int) -> Pattern:
        kept = [s.moved(-start, end - (s.end - s.start)) for s in self.seqlets if s.end - s.start >= end]
        return Pattern(self.tracks, kept)

    def to_support(self, min_share: float, min_n: int) -> Pattern:
        need = min(min_n, self.counts.max() * min_share)
        good = np.flatnonzero(self.counts >= need)
        first, last = int(good[0]), int(good[-1]) + 1
        kept = [Seqlet(*s.key, s.rc).moved(-first, min(last, s.end - s.start) - (s.end - s.start)) for s in self.seqlets]
        return Pattern(self.tracks, [s for s in kept if s.end > s.start])

    def expanded(self, left: int = 0, right: int = 0) -> Pattern:
        """All seqlets to the pattern's full width plus flanks; those that leave their track go."""
        width = len(self)
        grown = [s.moved(left, right + width - (s.end - s.start)) for s in self.seqlets]
        return Pattern(self.tracks, [s for s in grown if self.tracks.holds(s)])


def features(means: np.ndarray, hypothetical: bool = True, how: str = "l1") -> np.ndarray:
    """Flat features per position: [hypothetical, contribution] bases, each normalised over the whole matrix."""
    parts = []
    for m in ([means[2], means[1]] if hypothetical else [means[1]]):
        if how == "l1":
            size = np.abs(m).sum()
            parts.append(m / size if size else m)
        else:
            m = m - m.mean()
            parts.append(m / (np.linalg.norm(m) + 1e-7))
    return np.concatenate(parts, axis=1)


def align(parent: np.ndarray, child: np.ndarray, *, metric: str = "jaccard", min_overlap: float = 0.7, hypothetical: bool = True) -> tuple[int, bool, float]:
    """(offset, reverse, score): where the child lies best on the parent; reverse only if strictly better."""

    def best(c: np.ndarray) -> tuple[float, int]:
        how = "l1" if metric == "jaccard" else "magnitude"
        x, y = features(c, hypothetical, how), features(parent, hypothetical, how)
        pad = math.ceil(len(x) * (1 - min_overlap))
        last = len(y) - len(x) + pad
        found = (-np.inf, 0)
        for o in range(-pad, max(last, -pad) + 1):
            z = np.zeros_like(x)
            low, high = max(0, o), min(len(y), o + len(x))
            if high > low:
                z[low - o : high - o] = y[low:high]
            if metric == "jaccard":
                top = np.maximum(np.abs(x), np.abs(z)).sum()
                score = (np.minimum(np.abs(x), np.abs(z)) * np.sign(x) * np.sign(z)).sum() / top if top else 0.0
            else:
                size = np.linalg.norm(x) * np.linalg.norm(z)
                score = float((x * z).sum() / size) if size else 0.0
            if score > found[0]:
                found = (score, o)
        return found

    forward, backward = best(child), best(child[:, ::-1, ::-1])
    score, offset = backward if backward[0] > forward[0] else forward
    return offset, backward[0] > forward[0], float(score)


def merge(parent: Pattern, seqlets: list[Seqlet], **options) -> Pattern:
    """Fold seqlets into a pattern one by one, each aligned to the mean so far, filling edges on both sides. The pattern that is
    given stays as it is."""
    parent = Pattern(parent.tracks, parent.seqlets)
    for s in seqlets:
        offset, reverse, _ = align(parent.means, parent.tracks.read(s), **options)
        s = s.flipped() if reverse else s
        width = s.end - s.start
        grown = s.moved(max(offset, 0), max(len(parent) - (offset + width), 0))
        if not parent.tracks.holds(grown):
            continue
        left, right = max(-offset, 0), max(offset + width - len(parent), 0)
        if left or right:
            wider = parent.expanded(left, right)
            if not wider.seqlets:
                continue
            parent = wider
        parent.add(grown)
    return parent


def information(ppm: np.ndarray, background: np.ndarray, pseudocount: float = 0.001) -> np.ndarray:
    """Per position."""
    total = ppm.sum(axis=1, keepdims=True)
    ppm = np.divide(ppm, total, out=np.zeros_like(ppm), where=total > 0)
    return (ppm * np.log2((ppm + pseudocount) / (1 + 4 * pseudocount)) - background * np.log2(background)).sum(axis=1)


def polish(pattern: Pattern, *, min_share: float, min_n: int, flank: int, window: int, background: np.ndarray) -> Pattern | None:
    """Trim to support, expand, cut to the window with the most information, expand again; None if nothing is left."""
    pattern = pattern.to_support(min_share, min_n).expanded(flank, flank)
    if not pattern.seqlets:
        return None
    if len(pattern) > window:
        ic = information(pattern.means[0], background)
        sums = np.convolve(ic, np.ones(window), "valid")
        at = int(np.argmax(np.round(sums, 9)))
        pattern = pattern.trimmed(at, at + window)
    pattern = pattern.expanded(flank, flank)
    return pattern if pattern.seqlets else None


def seqlet_features(pattern: Pattern, seqlets: list[Seqlet]) -> np.ndarray:
    return np.stack([features(pattern.tracks.read(s)).ravel() for s in seqlets])


def pairwise_jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    from .similarity import jaccard_block

    return jaccard_block(a, b)


def rank_auroc(positive: np.ndarray, negative: np.ndarray) -> float:
    if not len(positive) or not len(negative):
        return 0.5
    values = np.concatenate([positive, negative])
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[at]
    n = len(positive)
    return float((rank[:n].sum() - n * (n + 1) / 2) / (n * len(negative)))


def pattern_pair(i: Pattern, j: Pattern, sample: int = 1000, seed: int = 1234, min_overlap: float = 0.7) -> tuple[float, float]:
    """(similarity of the means, auroc of within-i against i-to-shifted-j similarities)."""
    offset, reverse, sim = align(i.means, j.means, metric="pearson", min_overlap=min_overlap, hypothetical=False)

    def some(p: Pattern) -> list[Seqlet]:
        if len(p.seqlets) <= sample:
            return p.seqlets
        return [p.seqlets[k] for k in np.sort(np.random.RandomState(seed).choice(len(p.seqlets), sample, replace=False))]

    width = len(i)
    moved = []
    for s in some(j):
        s = s.flipped() if reverse else s
        placed = s.moved(offset, width - offset - (s.end - s.start))
        if placed.start >= 0 and placed.end < len(i.tracks[placed.example][0]):
            moved.append(placed)
    if not moved:
        return 0.0, 0.5
    own = seqlet_features(i, [s for s in some(i) if s.end - s.start == width])
    return sim, rank_auroc(pairwise_jaccard(own, own).ravel(), pairwise_jaccard(own, seqlet_features(i, moved)).ravel())


#: Which pairs merge (contamination at least, similarity at least) and what blocks a merge (at most both).
COLLAPSE = ((0.8, 0.8), (0.5, 0.85), (0.2, 0.9))
BLOCK = ((0.4, 0.75), (0.2, 0.8), (0.1, 0.85), (0.0, 0.9))


def merge_plan(sim: np.ndarray, auroc: np.ndarray) -> list[tuple[int, int]]:
    """Pairs i < j to merge, most similar first: similar and contaminated enough, and no blocking pair among partners."""
    both = (sim + sim.T) / 2
    dirt = 2 * (1 - np.maximum(auroc, 0.5))
    least, mean = np.minimum(dirt, dirt.T), (dirt + dirt.T) / 2
    partners = [{k} for k in range(len(sim))]
    plan = []
    for i, j in sorted(((i, j) for i in range(len(sim)) for j in range(i + 1, len(sim))), key=lambda p: -both[p]):
        if not any(least[i, j] >= t and both[i, j] >= s for t, s in COLLAPSE):
            continue
        group = sorted(partners[i] | partners[j])
        if any(mean[a, b] <= t and both[a, b] <= s for a in group for b in group if a < b for t, s in BLOCK):
            continue
        plan.append((i, j))
        for k in group:
            partners[k] = set(group)
    return plan


def replay(parts: dict[int, Pattern], plan: list[tuple[int, int, int]], join: Callable[[Pattern, Pattern], Pattern | None], refused: set[frozenset[int]]) -> tuple[dict[int, int], dict[int, Pattern], list[tuple[int, int]]]:
    """Carry out a plan of merges (a, b, name of what comes out) in its order over shared slots.

    A pair stands for what its two slots hold by then. Where `join` gives a pattern, every slot that held either side holds
    the new one; where it gives None, both sides stay as they are, and the pair is refused for good. Returns what each slot
    holds in the end (slot -> name), the patterns by name, and the pairs newly refused.
    """
    slot, held, found = {name: name for name in parts}, dict(parts), []
    known = set(refused)
    for i, j, name in plan:
        a, b = slot[i], slot[j]
        if a == b or frozenset((a, b)) in known:
            continue
        new = join(held[a], held[b])
        if new is None:
            known.add(frozenset((a, b)))
            found.append((a, b))
            continue
        held[name] = new
        slot = {k: name if at in (a, b) else at for k, at in slot.items()}
    return slot, {name: held[name] for name in dict.fromkeys(slot.values())}, found


def components(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """name -> the smallest name that the pairs connect it with."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}

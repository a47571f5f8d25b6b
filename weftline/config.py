"""Parameters of the sketch, the join and the chains, checked once."""

from __future__ import annotations

from dataclasses import dataclass

MASKS = ("none", "hpc", "microsat")


@dataclass(frozen=True)
class SketchParams:
    """``k`` symbols a k-mer; ``num_windows`` neighbouring windows of ``window_size + 1`` k-mers, the last k-mer of one
    being the first of the next; ``mask`` is applied to a strand before. ``block`` window positions of a strand are
    sketched together: hashes and minima exist for that many positions at a time, whatever the length of a sequence. Of a
    whole strand there are its letters and, for each symbol, its number and place."""

    k: int = 15
    num_windows: int = 2
    window_size: int = 30
    mask: str = "hpc"
    block: int = 1 << 16

    def __post_init__(self):
        if self.k < 2 or self.num_windows < 1 or self.window_size < 1 or self.block < 1:
            raise ValueError("k must be 2 or more, num_windows, window_size and block 1 or more")
        if self.mask not in MASKS:
            raise ValueError(f"mask must be one of {MASKS}")

    @property
    def span(self) -> int:
        """Symbols that the shortest sketched strand has."""
        return self.num_windows * self.window_size + self.k


@dataclass(frozen=True)
class JoinParams:
    """Occurrences a key may have (both strands count), the most by which the intervals of a match may differ in length,
    and the largest gap of diagonals inside a chain. The pairs of a key with more than ``split`` occurrences are dealt over
    tasks by a grid of such pieces; this changes no row."""

    min_coverage: int = 2
    max_coverage: int | None = None
    max_length_difference: int = 10_000
    chain_gap: int = 500
    split: int = 4096

    def __post_init__(self):
        if self.min_coverage < 1 or (self.max_coverage is not None and self.max_coverage < self.min_coverage):
            raise ValueError("coverage bounds are out of order")
        if self.max_length_difference < 0 or self.chain_gap < 0 or self.split < 1:
            raise ValueError("max_length_difference and chain_gap must not be negative, split must be 1 or more")

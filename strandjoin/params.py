"""Alignment parameters and the lengths that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Bases held by one BIGINT column at three bits each; the sign bit stays free.
BASES_PER_WORD = 21


@dataclass(frozen=True)
class AlignParams:
    """What to search for, and the size limits that steer the physical plan.

    The second group of fields only moves work around; results do not depend on it.
    """

    k: int = 3
    min_len: int = 36
    max_len: int = 36
    allow_differences: bool = False
    redundancy: int = 16
    chunk_overlap: int = 1024
    on_bad_length: str = "fail"  # or "drop"

    # Physical tuning.
    strategy: str = "auto"  # decide by the measured size, or always "shuffle"
    piece_len: int = BASES_PER_WORD * 192  # seed positions handled per piece
    broadcast_bytes: int = 256 << 20  # largest estimated read-tile table to broadcast
    hash_bytes: int = 64 << 20  # average read tiles per shuffle partition to join without sorting
    refine_fanout: int = 512  # read tiles on one seed above which its key is extended
    salt_rows: int = 4 << 20  # places of one seed per salt in the shuffled join

    def __post_init__(self) -> None:
        if self.k < 0:
            raise ValueError("k must not be negative")
        if not 0 < self.min_len <= self.max_len:
            raise ValueError("need 0 < min_len <= max_len")
        if self.seed_len < 1:
            raise ValueError("min_len must exceed k")
        if self.n_tiles > 64:
            raise ValueError("max_len holds more than 64 tiles of min_len // (k + 1) bases")
        if self.redundancy < 1:
            raise ValueError("redundancy must be at least 1")
        if self.chunk_overlap < 2 * self.flank_len + self.seed_len - 1:
            raise ValueError("chunk_overlap is too short to hold a seed and both flanks")
        if self.on_bad_length not in ("fail", "drop"):
            raise ValueError("on_bad_length must be 'fail' or 'drop'")
        if self.strategy not in ("auto", "shuffle"):
            raise ValueError("strategy must be 'auto' or 'shuffle'")
        if self.piece_len < 2 * self.max_len or self.piece_len % BASES_PER_WORD:
            raise ValueError("piece_len must be a multiple of 21 and cover one frame")
        if min(self.refine_fanout, self.salt_rows) < 1:
            raise ValueError("refine_fanout and salt_rows must be positive")

    @property
    def seed_len(self) -> int:
        """Tile length: k differences cannot touch all of k + 1 tiles."""
        return self.min_len // (self.k + 1)

    @property
    def key_len(self) -> int:
        """Leading bases of a tile that the join compares; one BIGINT holds them."""
        return min(self.seed_len, 18)

    @property
    def flank_len(self) -> int:
        return self.max_len - self.seed_len + self.k

    @property
    def n_tiles(self) -> int:
        return self.max_len // self.seed_len

    @property
    def left_reach(self) -> int:
        """Bases a read can extend to the left of its last seed."""
        return (self.n_tiles - 1) * self.seed_len

    @property
    def frame_len(self) -> int:
        """Bases around a seed that hold the read whichever tile the seed is."""
        return self.left_reach + self.max_len

    @property
    def frame_words(self) -> int:
        return -(-self.frame_len // BASES_PER_WORD)

    @property
    def flank_words(self) -> int:
        """Words that hold a seed and both of its flanks."""
        return -(-(2 * self.flank_len + self.seed_len) // BASES_PER_WORD)


def _grid_step(params: AlignParams) -> int:
    seeds, tile = params.k + 1, params.min_len // (params.k + 1)
    return min(
        (params.min_len + 1) // (seeds + 1),
        (params.flank_len + 1) // seeds,
        (params.min_len + 1 - tile) // seeds,
    )


@dataclass(frozen=True)
class GridParams(AlignParams):
    """The same search with its seeds on a grid of the reference, one in ``seed_len`` positions.

    Wherever a read lies, it covers k + 1 seeds of the grid, and k differences cannot touch all of
    them. Reads look up every window that may be one of those. N may seed, since N equals N.
    """

    @property
    def seed_len(self) -> int:
        """The longest step at which a read covers k + 1 seeds whatever its offset to the grid, and
        at which the places that a stored chunk owns by the tiles of the plain search suffice."""
        return _grid_step(self)

    @property
    def flank_len(self) -> int:
        """That of the plain search, as chunks were cut for it."""
        return self.max_len - self.min_len // (self.k + 1) + self.k

    @property
    def n_tiles(self) -> int:
        return self.k + 1

    @property
    def left_reach(self) -> int:
        """The last window of a read that may be one of its first k + 1 seeds."""
        return self.n_tiles * self.seed_len - 1


def grid_params(params: AlignParams) -> GridParams | None:
    """None where seeds on the grid would be at most half as long as tiles, thus far less selective."""
    if 2 * _grid_step(params) <= params.seed_len:
        return None
    return GridParams(**{f.name: getattr(params, f.name) for f in fields(AlignParams)})

"""Settings of the slicing operators. They travel in closures and arguments, never in the Spark configuration."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

LIMITS = (50, 100_000)
DEFAULT_LIMIT, DEFAULT_CHUNK = 4096, 256


@dataclass(frozen=True)
class SliceOptions:
    """limit: budget of a paragraph; overlap: carried characters (overlap_ratio: as a share of limit); boundary: cut at
    sentence ends, looked for in the last 1 - lookback of a window; min_chunk: shorter pieces join the one before;
    length_fn: another measure than code points; patterns: heading patterns, outermost first (None: markdown)."""

    limit: int = DEFAULT_LIMIT
    overlap: int = 0
    overlap_ratio: float | None = None
    boundary: bool = True
    lookback: float = 0.5
    overlap_boundary: bool = True
    overlap_within_section: bool = False
    min_chunk: int = 0
    length_fn: Callable[[str], int] | None = None
    with_filter: bool = False
    patterns: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.lookback < 1:
            raise ValueError("lookback must lie in [0, 1)")
        if self.overlap < 0 or self.min_chunk < 0:
            raise ValueError("overlap and min_chunk cannot be negative")
        if self.overlap_ratio is not None and not 0 <= self.overlap_ratio <= 1:
            raise ValueError("overlap_ratio must lie in [0, 1]")

    def resolved(self) -> SliceOptions:
        """With the limit held in its bounds and the overlap as characters, at most half the limit."""
        limit = min(max(int(self.limit), LIMITS[0]), LIMITS[1])
        overlap = int(limit * self.overlap_ratio) if self.overlap_ratio is not None else int(self.overlap)
        return replace(self, limit=limit, overlap=min(overlap, limit // 2), overlap_ratio=None)


@dataclass(frozen=True)
class ParserLimits:
    """Bounds of the format readers; each can be set by the environment variable VELLUMARK_PARSER_<NAME>."""

    max_bytes: int = 256 << 20
    max_xml_bytes: int = 32 << 20
    max_xml_depth: int = 128
    max_xml_elements: int = 100_000
    max_members: int = 10_000
    max_member_bytes: int = 256 << 20
    max_cells: int = 1_000_000
    max_repeat: int = 1_000
    max_depth: int = 16
    max_parts: int = 1_000

    @classmethod
    def from_environment(cls) -> ParserLimits:
        values = {f.name: os.environ.get(f"VELLUMARK_PARSER_{f.name.upper()}") for f in fields(cls)}
        return cls(**{k: int(v) for k, v in values.items() if v})

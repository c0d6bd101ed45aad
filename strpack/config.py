"""Training options, with the rules by which out-of-range values are brought into range."""

from __future__ import annotations

import math
from dataclasses import dataclass

BYTES = 256  # tokens 0..255 are the single bytes
TOP_ID = 65535
TOP_ID_12 = 4095
SAMPLE_BYTES = 1 << 20
CLUSTERS = 2048


class ShortBufferError(ValueError):
    """The decoded bytes do not fit into the capacity asked for."""


class UntrainedModelError(RuntimeError):
    """A model was used before it was trained."""


class CorruptArchiveError(ValueError):
    """An archive, or a serialized one, contradicts itself."""


@dataclass(frozen=True)
class Config:
    """threshold: pair count that makes a token (0: from the sample's size). max_token_id: last id (0: 65535).
    max_token_length: bytes in a token (0 or less: no limit; 16 also limits long tokens with a common start to 128).
    token_bits: 12 or 16 (anything else means 16). sample_bytes: training budget (0 or less: 1 MiB).
    stratified, max_clusters: draw the sample in proportion to line templates, of at most so many kinds (0: 2048)."""

    threshold: int = 0
    max_token_id: int = 0
    max_token_length: int = 0
    token_bits: int = 16
    sample_bytes: int = 0
    stratified: bool = False
    max_clusters: int = 0

    def __post_init__(self) -> None:
        for name in ("threshold", "max_token_id"):
            if not 0 <= getattr(self, name) <= TOP_ID:
                raise ValueError(f"{name} must be in 0..{TOP_ID}")

    @property
    def bits(self) -> int:
        return 12 if self.token_bits == 12 else 16

    @property
    def last_id(self) -> int:
        top = TOP_ID if self.max_token_id == 0 else max(self.max_token_id, BYTES - 1)
        return min(top, TOP_ID_12) if self.bits == 12 else top

    @property
    def budget(self) -> int:
        return self.sample_bytes if self.sample_bytes > 0 else SAMPLE_BYTES

    @property
    def clusters(self) -> int:
        return self.max_clusters if self.max_clusters > 0 else CLUSTERS

    def pair_threshold(self, sampled: int) -> int:
        if self.threshold:
            return self.threshold
        return int(max(2.0, math.log2(sampled / (1 << 20)))) if sampled else 2

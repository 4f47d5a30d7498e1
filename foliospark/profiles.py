"""What a run aims for: resolution, fidelity, and what it discards."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RemovalOptions:
    """Parts of a document that are discarded."""

    remove_alternate_images: bool = False
    remove_article_threads: bool = True
    remove_metadata: bool = True
    remove_output_intents: bool = False
    remove_piece_info: bool = True
    remove_structure_tree: bool = True
    remove_thumbnails: bool = True


@dataclass(frozen=True)
class Profile:
    """Options of a run; the defaults are those of the profile `web`.

    An axis is downsampled to `resolution_dpi` (None: never) only above `threshold_ratio` times that. `compression_quality`
    from 0 to 1 moves the floor of fidelity. `progressive_jpeg` writes JPEG data in scans of rising detail.
    """

    resolution_dpi: float | None = 150.0
    threshold_ratio: float = 1.4
    compression_quality: float = 0.8
    reduce_color_complexity: bool = True
    crop_to_visible: bool = True
    progressive_jpeg: bool = False
    declare_srgb: bool = False
    removal: RemovalOptions = field(default_factory=RemovalOptions)

    def __post_init__(self):
        if not 0.0 <= self.compression_quality <= 1.0:
            raise ValueError("quality must be between 0 and 1")
        if self.resolution_dpi is not None and self.resolution_dpi <= 0:
            raise ValueError("dpi must be positive")

    @property
    def threshold_dpi(self) -> float:
        return (self.resolution_dpi or 0.0) * self.threshold_ratio


@dataclass(frozen=True)
class Web(Profile):
    """For screens: 150 dpi."""


@dataclass(frozen=True)
class MinimalFileSize(Profile):
    """As small as is viable: 130 dpi, and no output intents."""

    resolution_dpi: float | None = 130.0
    compression_quality: float = 0.75
    removal: RemovalOptions = field(default_factory=lambda: RemovalOptions(remove_output_intents=True))


PROFILES = {"web": Web, "minimal": MinimalFileSize}

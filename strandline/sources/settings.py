"""Settings: one frozen record, read from and written to JSON; unknown or broken values fall back to defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

#: Choices of each enumerated field.
CHOICES = {"image_format": ("JPG", "PNG", "WEBP"), "pack": ("ZIP", "CBZ", "FILES"), "rule": ("WHOLE", "MAX_HEIGHT", "PAGES_PER_PACK"), "strictness": ("LOOSE", "BALANCED", "STRICT"), "theme": ("SYSTEM", "LIGHT", "DARK"), "matte": ("WHITE", "BLACK", "CLEAR")}
#: Edge, range and margin of row scans, and pages a banner needs, by strictness.
PRESETS = {"LOOSE": (30, 52, 6, 4), "BALANCED": (24, 40, 10, 8), "STRICT": (18, 30, 14, 16)}


@dataclass(frozen=True)
class Settings:
    image_format: str = "JPG"
    jpg_quality: int = 90
    webp_quality: int = 90
    pack: str = "ZIP"
    series: str = "Series"
    chapter: str = "1"
    pattern: str = "{series}_ch{chapter}_{n}"
    number_width: int = 3
    rule: str = "MAX_HEIGHT"
    max_height: int = 10_000
    pages_per_pack: int = 10
    review_flags: bool = True
    matte: str = "WHITE"
    theme: str = "SYSTEM"
    strictness: str = "BALANCED"
    banner_cut: bool = True

    @property
    def encode_quality(self) -> int:
        """Of the image format, between 10 and 100; PNG has no loss."""
        return {"PNG": 100, "JPG": min(100, max(10, self.jpg_quality)), "WEBP": min(100, max(10, self.webp_quality))}[self.image_format]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str | None) -> Settings:
        try:
            raw = json.loads(text or "{}")
        except ValueError:
            raw = {}
        good = {}
        for f in fields(cls):
            v = raw.get(f.name) if isinstance(raw, dict) else None
            if type(v) is type(f.default) and (f.name not in CHOICES or v in CHOICES[f.name]):
                good[f.name] = v
        return cls(**good)

"""Conversion options: an immutable value, validated before any job starts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from folioweave import rules

# Options that steer result reuse and therefore are not part of its key.
REUSE_ONLY = ("enable_cache", "cache_max_age_hours", "results_path")


@dataclass(frozen=True)
class Options:
    strategy: str = "auto"
    image_mode: str = "link"
    table_format: str = "github"
    extract_images: bool = True
    extract_tables: bool = True
    include_metadata: bool = True
    include_page_breaks: bool = False
    page_break_marker: str = rules.PAGE_BREAK
    html_base_url: str | None = None
    html_preserve_semantic: bool = True
    xlsx_mode: str = "combined"
    xlsx_sheets: str | None = None
    xlsx_max_sheet_width: int = rules.SHEET_COLUMNS
    text_passthrough: bool = False
    validate_output: bool = True
    max_bytes: int = rules.UPLOAD_LIMIT_BYTES
    enable_cache: bool = True
    cache_max_age_hours: int = rules.CACHE_HOURS
    results_path: str | None = None

    def __post_init__(self) -> None:
        for name, allowed in (
            ("strategy", rules.STRATEGIES),
            ("image_mode", rules.IMAGE_MODES),
            ("table_format", rules.TABLE_FORMATS),
            ("xlsx_mode", rules.WORKBOOK_MODES),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        if self.xlsx_max_sheet_width < 1:
            raise ValueError("xlsx_max_sheet_width must be at least 1")

    def with_(self, **changes) -> "Options":
        """A changed copy; the receiver stays as it is."""
        return replace(self, **changes)

    def key_json(self) -> str:
        """Compact JSON with sorted keys, without the reuse-only options."""
        kept = {k: v for k, v in asdict(self).items() if k not in REUSE_ONLY}
        return json.dumps(kept, sort_keys=True, separators=(",", ":"))

    def config_hash(self) -> str:
        return hashlib.sha256(self.key_json().encode()).hexdigest()[:16]

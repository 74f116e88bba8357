"""Every knob of a reduction run."""

from __future__ import annotations

from dataclasses import dataclass

# Names, defaults and modes are the contract of a run.
#: Page coverage from which a page is kept as a picture, by mode.
MODES = {"text": 0.05, "mixed": 0.20, "slides": 0.50, "text_only": 1.01}
CHARS_PER_TOKEN = 4.0
COVERAGE_GRID = 32
REGION_CELL = 10.0
LAYOUT_CELL = 300


@dataclass(frozen=True)
class Settings:
    image_threshold: float = 0.05
    render_zoom: float = 2.0
    min_image_fraction: float = 0.004
    vector_min_paths: int = 60
    vector_max_chars: int = 400
    dehyphenate: bool = True
    normalise_punctuation: bool = True
    strip_repeated_lines: bool = True
    repeat_ratio: float = 0.5
    repeat_scan_lines: int = 3
    drop_page_numbers: bool = True
    render_visual_pages: bool = True
    write_manifest: bool = True
    output_dir: str | None = None
    clean_target: bool = True
    extract_tables: bool = False
    table_min_lines: int = 4
    table_max_thin_columns: float = 0.5
    table_max_mean_cell: int = 120
    table_max_cell: int = 600
    chart_regions: bool = False
    chart_min_area: float = 0.04
    chart_max_area: float = 0.98
    chart_min_paths: int = 3
    chart_margin: float = 18.0
    chart_max_words_per_line: float = 4.0
    ocr: bool = False
    ocr_language: str = "eng"
    ocr_dpi: int = 200
    scan_max_chars: int = 24
    scan_min_coverage: float = 0.8

    @property
    def dpi(self) -> int:
        return round(72 * self.render_zoom)

    @property
    def renders(self) -> bool:
        """Whether any page may be kept as a picture."""
        return self.render_visual_pages and self.image_threshold <= 1.0

    @classmethod
    def of_request(cls, threshold_percent: float = 5, dpi: float = 144, text_only: bool = False, tables: bool = False, figures: bool = False) -> Settings:
        """Settings from what a user enters: a percentage and a resolution."""
        never = text_only or threshold_percent >= 100
        return cls(image_threshold=1.01 if never else threshold_percent / 100, render_zoom=max(0.25, dpi / 72), render_visual_pages=not never, extract_tables=tables, chart_regions=figures)


DEFAULT = Settings()

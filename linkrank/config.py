"""Parameters and table locations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Category cohorts, cohort name to category title.
CATEGORY_GROUPS = {
    "category_mathematics": "Mathematics",
    "category_physics": "Physics",
    "category_computer_science": "Computer_science",
    "category_history": "History",
    "category_biology": "Biology",
    "category_philosophy": "Philosophy",
}


@dataclass(frozen=True)
class Params:
    """What the operators take; the defaults are those of a full run over a large dump."""

    min_page_len: int = 100  # bytes, strictly more
    min_words: int = 100  # words, at least
    damping: float = 0.85
    tolerance: float = 1e-8
    max_iterations: int = 100
    group_size: int = 500
    shingle_size: int = 3
    permutations: int = 128
    seed: int = 4022
    categories: Mapping[str, str] = field(default_factory=lambda: dict(CATEGORY_GROUPS))
    median_low: float = 0.45
    median_high: float = 0.55
    strict_escape: bool = False  # True: one pass over escapes instead of replacing them one after another


@dataclass(frozen=True)
class Layout:
    """Folders of a run; any file system that Spark knows."""

    raw: str
    processed: str
    results: str

    def raw_file(self, name: str) -> str:
        return f"{self.raw.rstrip('/')}/{name}"

    def table(self, name: str) -> str:
        return f"{self.processed.rstrip('/')}/{name}"

    def result(self, name: str) -> str:
        return f"{self.results.rstrip('/')}/{name}"

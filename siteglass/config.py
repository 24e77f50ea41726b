"""Settings of an audit: typed defaults, overrides by dotted name, and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Width:
    min_chars: int
    max_chars: int
    min_px: int
    max_px: int


# Thresholds and word lists of the checks.
@dataclass(frozen=True)
class Thresholds:
    title: Width = Width(30, 60, 200, 561)
    description: Width = Width(70, 155, 400, 985)
    url_max_chars: int = 115
    h1_max_chars: int = 70
    h2_max_chars: int = 70
    image_alt_max_chars: int = 100
    image_max_kb: int = 100
    low_content_words: int = 200
    high_crawl_depth: int = 4
    high_internal_outlinks: int = 1000
    high_external_outlinks: int = 100
    non_descriptive_anchors: tuple[str, ...] = ("click here", "click", "here", "read more", "more", "learn more", "go", "this page", "start", "right here")
    soft_404_patterns: tuple[str, ...] = ("page not found", "404", "not be found")


@dataclass(frozen=True)
class Links:
    external_store: bool = False
    uncrawlable_store: bool = False


@dataclass(frozen=True)
class Content:
    include_elements: tuple[str, ...] = ()
    include_classes: tuple[str, ...] = ()
    include_ids: tuple[str, ...] = ()
    exclude_elements: tuple[str, ...] = ("nav", "footer")
    exclude_classes: tuple[str, ...] = ()
    exclude_ids: tuple[str, ...] = ()
    near_duplicates: bool = False
    near_duplicate_threshold: int = 90
    near_duplicate_indexable_only: bool = True


@dataclass(frozen=True)
class Limits:
    max_depth: int = -1
    max_urls_per_depth: int = -1
    max_folder_depth: int = -1
    max_query_strings: int = -1
    max_per_subdomain: int = -1
    max_url_length: int = 10_000
    max_links_per_page: int = 10_000
    by_path: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Advanced:
    crawl_fragments: bool = False
    lowercase_hex: bool = False
    extract_srcset: bool = False
    ignore_non_indexable_for_issues: bool = False
    ignore_paginated_for_duplicates: bool = False
    respect_self_referencing_meta_refresh: bool = True
    terminated_references: bool = False  # HTML also decodes some references without a semicolon


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    links: Links = field(default_factory=Links)
    content: Content = field(default_factory=Content)
    limits: Limits = field(default_factory=Limits)
    advanced: Advanced = field(default_factory=Advanced)
    images_store: bool = False
    structured_jsonld: bool = False
    structured_microdata: bool = False
    structured_rdfa: bool = False
    robots_user_agent: str = "siteglass"
    store_link_paths: bool = True
    link_positions: tuple[tuple[str, str], ...] = (("head", "/head/"), ("nav", "nav"), ("header", "header"), ("aside", "aside"), ("footer", "footer"), ("content", "/"))
    change_detection: tuple[str, ...] = ("titles", "descriptions", "h1", "word_count", "crawl_depth", "links", "structured_data", "content")
    content_change_threshold: float = 10.0

    def with_values(self, **values: Any) -> Config:
        """A copy with overrides such as ``{"thresholds.url_max_chars": 80}``; an unknown name is an error."""
        out = self
        for name, value in values.items():
            out = _set(out, name.split("."), value)
        return out.checked()

    def checked(self) -> Config:
        for w in (self.thresholds.title, self.thresholds.description):
            if w.min_chars > w.max_chars or (w.max_px > 0 and w.min_px > w.max_px):
                raise ValueError(f"a width's least value is over its greatest: {w}")
        if not 0 <= self.content.near_duplicate_threshold <= 100:
            raise ValueError("content.near_duplicate_threshold is a percentage")
        return self


def _set(at: Any, path: list[str], value: Any) -> Any:
    if not is_dataclass(at) or path[0] not in {f.name for f in fields(at)}:
        raise KeyError(f"unknown setting {path[0]!r}")
    return replace(at, **{path[0]: value if len(path) == 1 else _set(getattr(at, path[0]), path[1:], value)})


DEFAULT = Config()

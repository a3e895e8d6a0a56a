"""Defaults of every operator, in one place: native and kernel forms of an operator share them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gates:
    min_block_bytes: int = 512
    bytes_per_token: float = 4.0
    token_margin: float = 1.2
    json_max_ratio: float = 0.85
    log_max_ratio: float = 0.8


@dataclass(frozen=True)
class CrushConfig:
    """Arrays of JSON values."""

    min_items: int = 5
    max_items: int = 15
    sigmas: float = 2.0
    near_constant: float = 0.1
    first_share: float = 0.3
    last_share: float = 0.15
    dropped_sample: int = 3
    min_savings: float = 0.15
    rare_cover: float = 0.8
    rare_most_values: int = 50
    rare_top: int = 5
    structural_share: float = 0.2


@dataclass(frozen=True)
class LogConfig:
    min_lines: int = 50
    max_errors: int = 10
    max_warnings: int = 5
    max_traces: int = 3
    trace_lines: int = 20
    context: int = 3
    max_lines: int = 100
    head_frames: int = 3
    app_frames: int = 5


@dataclass(frozen=True)
class SearchConfig:
    per_file: int = 5
    total: int = 30
    files: int = 15
    min_matches: int = 10
    marker_below: float = 0.8


@dataclass(frozen=True)
class DiffConfig:
    min_lines: int = 50
    context: int = 2
    files: int = 20
    hunks: int = 10
    marker_below: float = 0.8
    noise_min_lines: int = 30
    noise_share: float = 0.5


@dataclass(frozen=True)
class TextConfig:
    ratio: float = 0.5
    min_segments: int = 6
    near_dup: float = 0.85
    recency: float = 1.0
    relevance: float = 2.0
    salience: float = 1.5
    short_bytes: int = 12
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class CodeConfig:
    min_tokens: int = 100
    body_lines: int = 5
    min_ratio: float = 0.05


@dataclass(frozen=True)
class TemplateConfig:
    min_lines: int = 20
    min_run: int = 3
    similarity: float = 0.4
    min_constants: int = 2


@dataclass(frozen=True)
class StashConfig:
    ttl_seconds: int = 1800
    max_slice_lines: int = 1000
    key_chars: int = 24


GATES, CRUSH, LOG, SEARCH, DIFF, TEXT, CODE, TEMPLATE, STASH = (
    Gates(), CrushConfig(), LogConfig(), SearchConfig(), DiffConfig(), TextConfig(), CodeConfig(), TemplateConfig(), StashConfig(),
)

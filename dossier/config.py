"""Tunable settings. Every operator takes them as arguments; nothing here is global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    """Knobs of the retrieval chain (defaults are fixed values of the published system)."""

    top_k: int = 3
    rerank_factor: int = 4
    table_pool_max: int | None = 50  # None: every table is a candidate
    text_fetch_k: int = 160
    bm25_top_n: int = 10
    bm25_enabled: bool = True
    rerank_shortlist: int = 0
    code_token_bonus: float = 1.0
    table_floor: bool = True
    split_results: bool = True

    @property
    def fetch_k(self) -> int:
        return self.top_k * self.rerank_factor


@dataclass(frozen=True)
class TextConfig:
    """Knobs of text preparation."""

    repeat_min_pages: int = 5
    min_content_chars: int = 30
    window_max_chars: int = 2000
    embed_section_path: bool = True
    questions_per_chunk: int = 0


@dataclass(frozen=True)
class AuditConfig:
    """Knobs of audit requests, replies and pacing analysis."""

    # The two verdict labels and the error state, English form.
    compliant: str = "COMPLIANT"
    violation: str = "NON_COMPLIANT"
    error: str = "NOT_EVALUATED"
    context_char_cap: int | None = None  # the published system cuts at 24,000
    cut_marker: str = "\n…[truncated]"
    calls_per_window: int = 5
    window_seconds: int = 60
    wait_margin_seconds: float = 0.5

    @property
    def verdicts(self) -> tuple[str, str]:
        return (self.compliant, self.violation)


# Rows per span of a two-level ordered scan (see functions/scan.py).
SPAN_ROWS = 4096

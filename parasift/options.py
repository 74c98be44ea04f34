"""Job options (driver-side, small).

``from_map`` follows the reference's string-map override rules: a key is
applied only if its value parses; unparsable values and unknown keys are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Defaults that change results.
DEFAULT_MMR_LAMBDA = 0.65  # what the command line hands the analyzer
DEFAULT_TOP_N = 10
DEFAULT_TOP_M = 30
DEFAULT_QUERY_MODE = "centroid_summary"
DEFAULT_MAX_SEQ_LEN = 512
SUMMARY_STYLES = ("abstract_with_bullets", "tldr", "extractive")
DEFAULT_STYLE = "abstract_with_bullets"
DEFAULT_TEMPERATURE = 0.2
DEFAULT_CHAT_MODEL = "gpt-3.5-turbo"
DEFAULT_BASE_URL = "https://api.openai.com/v1"
DEFAULT_TIMEOUT_MS = 30000

_FLOAT_RE = re.compile(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$", re.I)
_UINT_RE = re.compile(r"^\+?\d+$")


def parse_float(v: str):
    return float(v) if _FLOAT_RE.match(v) else None


def parse_uint(v: str, bits: int = 64):
    if not _UINT_RE.match(v):
        return None
    n = int(v)
    return n if n < (1 << bits) else None


def parse_bool(v: str):
    return {"true": True, "false": False}.get(v)


@dataclass(frozen=True)
class AnalyzerOptions:
    mmr_lambda: float = DEFAULT_MMR_LAMBDA
    top_n: int = DEFAULT_TOP_N
    rerank: bool = False
    top_m: int = DEFAULT_TOP_M
    query_mode: str = DEFAULT_QUERY_MODE
    max_seq_len: int = DEFAULT_MAX_SEQ_LEN
    backend: str = "onnx"
    allow_downloads: bool = True
    # largest group handled by the grouped MMR path (rows)
    max_group_rows: int = 50_000

    @classmethod
    def from_map(cls, settings: dict[str, str], base: "AnalyzerOptions | None" = None) -> "AnalyzerOptions":
        o = base or cls()
        for k, v in settings.items():
            if k == "backend":
                o = replace(o, backend=v)
            elif k == "mmr_lambda" and parse_float(v) is not None:
                o = replace(o, mmr_lambda=parse_float(v))
            elif k == "top_n" and parse_uint(v) is not None:
                o = replace(o, top_n=parse_uint(v))
            elif k == "rerank" and parse_bool(v) is not None:
                o = replace(o, rerank=parse_bool(v))
            elif k == "allow_downloads" and parse_bool(v) is not None:
                o = replace(o, allow_downloads=parse_bool(v))
        return o


def style_from_name(name: str | None) -> str:
    """Unknown style names fall back to the bullets style."""
    return name if name in SUMMARY_STYLES else DEFAULT_STYLE


@dataclass(frozen=True)
class SummarizerOptions:
    base_url: str = DEFAULT_BASE_URL
    model: str = DEFAULT_CHAT_MODEL
    timeout_ms: int = DEFAULT_TIMEOUT_MS
    temperature: float = DEFAULT_TEMPERATURE
    max_tokens: int | None = None
    style: str = DEFAULT_STYLE

    @classmethod
    def from_map(cls, settings: dict[str, str], base: "SummarizerOptions | None" = None) -> "SummarizerOptions":
        o = base or cls()
        for k, v in settings.items():
            if k == "base_url":
                o = replace(o, base_url=v)
            elif k == "model":
                o = replace(o, model=v)
            elif k == "timeout_ms" and parse_uint(v) is not None:
                o = replace(o, timeout_ms=parse_uint(v))
            elif k == "temperature" and parse_float(v) is not None:
                o = replace(o, temperature=parse_float(v))
            elif k == "max_tokens" and parse_uint(v, 32) is not None:
                o = replace(o, max_tokens=parse_uint(v, 32))
            elif k == "style":
                o = replace(o, style=style_from_name(v))
        return o


@dataclass(frozen=True)
class StoreOptions:
    enabled: bool = True
    path: str | None = None
    ttl_days: int | None = None

"""Settings, each overridable by an environment variable of its upper-case name with the prefix ``TARN_``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    # Defaults that results depend on.
    chunk_size_words: int = 200
    chunk_overlap_words: int = 40
    top_k: int = 5
    similarity_threshold: float = 0.35
    related_similarity_threshold: float = 0.33
    retrieval_mode: str = "vector"
    fusion_pool: int = 15
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    raw_fetch_k: int = 15
    page_size: int = 100
    request_timeout_seconds: float = 30.0
    rate_limit_retries: int = 4
    rate_limit_backoff_seconds: float = 15.0
    question_delay_seconds: float = 5.0
    price_per_million_prompt_tokens: float = 0.15
    price_per_million_completion_tokens: float = 0.60
    preview_characters: int = 300
    embedding_dim: int = 384
    documents_url: str = "http://localhost:8000"
    llm_url: str = ""
    llm_model: str = ""
    llm_key: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        """Read overrides; a value that doesn't parse as its setting's type is an error at once."""
        env = dict(os.environ) if env is None else env
        found = {}
        for field in fields(cls):
            raw = env.get(f"TARN_{field.name.upper()}")
            if raw is not None:
                found[field.name] = type(field.default)(raw)
        return cls(**found)


DEFAULTS = Config()

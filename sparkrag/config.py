"""Settings: defaults, overridden by environment variables SPARKRAG_<NAME>."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    index_dir: str = "index"
    index_type: str = "flat"
    vector_backend: str = "parquet"
    embedding_provider: str = "hashing"
    embedding_model: str = "hashed-tokens"
    embedding_dim: int = 256
    retrieval_mode: str = "dense"
    top_k: int = 4
    candidate_k: int = 20
    fusion_k: int = 60
    rerank: bool = False
    chunk_size: int = 512
    chunk_overlap: int = 64
    chat_window_minutes: int = 10
    chat_max_messages: int = 20
    max_tokens: int = 1024
    llm: str = "extractive"
    llm_fallback: str = ""

    @classmethod
    def load(cls, **values) -> Settings:
        """Defaults, then the environment, then values."""
        for f in dataclasses.fields(cls):
            raw = os.environ.get(f"SPARKRAG_{f.name.upper()}")
            if raw is not None and f.name not in values:
                kind = type(f.default)
                values[f.name] = raw.lower() in {"1", "true", "yes"} if kind is bool else kind(raw)
        return cls(**values)


@dataclasses.dataclass(frozen=True)
class ForumChunks:
    """Token budgets of forum chunks."""

    max_tokens: int = 700
    overlap_tokens: int = 100
    short_post_tokens: int = 40
    previous_context_tokens: int = 300
    dump_min_tokens: int = 4000
    dump_min_lines: int = 100
    dump_dense_chunks: int = 8

    def __post_init__(self):
        rules = (
            (self.max_tokens >= 64, "max_tokens must be at least 64"),
            (0 <= self.overlap_tokens < self.max_tokens, "overlap_tokens must be smaller than max_tokens"),
            (0 < self.short_post_tokens < self.max_tokens, "short_post_tokens must be between 1 and max_tokens"),
            (0 < self.previous_context_tokens < self.max_tokens, "previous_context_tokens must be between 1 and max_tokens"),
            (self.dump_min_tokens >= self.max_tokens, "dump_min_tokens must be at least max_tokens"),
            (self.dump_min_lines >= 10, "dump_min_lines must be at least 10"),
            (self.dump_dense_chunks >= 1, "dump_dense_chunks must be at least 1"),
        )
        for kept, says in rules:
            if not kept:
                raise ValueError(says)

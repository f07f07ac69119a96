"""Settings of the engine, from arguments or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

ANSWER_MODES = ("patient", "clinician")
PARSER_VERSION = "pymupdf-sorted-text-v1"
CHUNKING_STRATEGY = "section_sentence_window_v1"
INDEX_SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Settings:
    source_path: str = "pdfs"
    index_path: str = ".rag/index"
    chunk_size_chars: int = 1400
    chunk_overlap_chars: int = 220
    top_k: int = 5
    embedding_backend: str = "auto"
    embedding_dimensions: int = 768
    ollama_url: str = "http://localhost:11434"
    ollama_embedding_model: str = "nomic-embed-text"
    ollama_generation_model: str = "llama3.1"
    generation_backend: str = "extractive"
    answer_mode: str = "patient"
    temperature: float = 0.1
    request_timeout_seconds: float = 20.0
    cache_path: str | None = None
    manifest_path: str | None = None
    extraction_cache_path: str | None = None
    pdf_workers: int = 1
    embedding_batch_size: int = 64
    ocr_scanned: bool = False
    min_relevance_score: float = 0.0
    reranker_backend: str = "lexical"
    hybrid_alpha: float = 0.5  # accepted and unused: fusion is by ranks

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap_chars < self.chunk_size_chars:
            raise ValueError(f"A chunk has at least one character and overlaps by fewer than it has: not {self.chunk_size_chars} with chunk_overlap_chars {self.chunk_overlap_chars}")
        answer_mode(self.answer_mode)

    def but(self, **changes: object) -> Settings:
        """A copy with other values; None leaves a value as it is."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        values: dict[str, object] = {"cache_path": ".rag/embedding_cache", "manifest_path": ".rag/manifest", "extraction_cache_path": ".rag/extracted"}
        for field, (kind, *names) in ENVIRONMENT.items():
            found = next((env[n] for n in names if env.get(n)), None)  # an empty value is an unset one
            if found is not None:
                values[field] = found.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(found)
                if field in NAMED:
                    values[field] = found.lower()
        legacy = env.get("VECTOR_DB_PATH")
        if legacy and "index_path" not in values:
            values["index_path"] = legacy if "." in legacy.rstrip("/").rpartition("/")[2].lstrip(".") else f"{legacy.rstrip('/')}/index"
        return cls(**values)


#: Settings whose values are names, in any case.
NAMED = ("embedding_backend", "generation_backend", "answer_mode", "reranker_backend")
#: Names of variables, the current one first and older ones after it.
ENVIRONMENT: dict[str, tuple] = {
    "source_path": (str, "RAG_CORPUS_DIR", "PDF_FOLDER"),
    "index_path": (str, "RAG_INDEX_PATH"),
    "chunk_size_chars": (int, "RAG_CHUNK_SIZE_CHARS", "CHUNK_SIZE"),
    "chunk_overlap_chars": (int, "RAG_CHUNK_OVERLAP_CHARS", "CHUNK_OVERLAP"),
    "top_k": (int, "RAG_TOP_K", "TOP_K"),
    "embedding_backend": (str, "RAG_EMBEDDING_BACKEND"),
    "embedding_dimensions": (int, "RAG_HASH_EMBEDDING_DIMENSIONS"),
    "ollama_url": (str, "RAG_OLLAMA_BASE_URL", "OLLAMA_BASE_URL"),
    "ollama_embedding_model": (str, "RAG_OLLAMA_EMBEDDING_MODEL", "OLLAMA_EMBEDDING_MODEL"),
    "ollama_generation_model": (str, "RAG_OLLAMA_GENERATION_MODEL", "OLLAMA_MODEL"),
    "generation_backend": (str, "RAG_GENERATION_BACKEND"),
    "answer_mode": (str, "RAG_ANSWER_MODE"),
    "temperature": (float, "RAG_TEMPERATURE", "TEMPERATURE"),
    "request_timeout_seconds": (float, "RAG_REQUEST_TIMEOUT_SECONDS"),
    "cache_path": (str, "RAG_EMBEDDING_CACHE_PATH"),
    "manifest_path": (str, "RAG_MANIFEST_PATH"),
    "extraction_cache_path": (str, "RAG_EXTRACTION_CACHE_DIR"),
    "pdf_workers": (int, "RAG_PDF_WORKERS"),
    "embedding_batch_size": (int, "RAG_EMBED_BATCH_SIZE"),
    "ocr_scanned": (bool, "RAG_OCR_SCANNED"),
    "min_relevance_score": (float, "RAG_MIN_RELEVANCE_SCORE"),
    "reranker_backend": (str, "RAG_RERANKER_BACKEND"),
    "hybrid_alpha": (float, "RAG_HYBRID_ALPHA"),
}


def answer_mode(mode: str) -> str:
    cleaned = mode.strip().lower()
    if cleaned not in ANSWER_MODES:
        raise ValueError(f"answer_mode must be one of {', '.join(ANSWER_MODES)}")
    return cleaned


def candidate_limit(top_k: int) -> int:
    return min(max(4 * top_k, top_k), 50)


def question_limit(top_k: int | None, settings: Settings) -> int:
    """None and 0 mean the default."""
    limit = top_k or settings.top_k
    if limit < 0:
        raise ValueError("top_k must be positive")
    return limit

"""Settings of the attribution engine. Ranges are not checked.

Fixed values: the names and defaults of the fields, and those of the presets, are part of the semantics.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TokenizerConfig:
    normalize_numbers: bool = True
    normalize_percent: bool = True
    normalize_currency: bool = True


@dataclass(frozen=True)
class CitationWeights:
    alignment: float = 1.0
    answer_coverage: float = 1.0
    evidence_coverage: float = 0.0
    lexical: float = 0.5
    embedding: float = 0.5


@dataclass(frozen=True)
class CitationConfig:
    weights: CitationWeights = field(default_factory=CitationWeights)
    top_k: int = 3
    min_final_score: float = 0.0
    min_alignment_score: int = 0
    min_answer_coverage: float = 0.2
    supported_answer_coverage: float = 0.6
    allow_embedding_only: bool = False
    min_embedding_similarity: float = 0.3
    supported_embedding_similarity: float = 0.6
    window_size_sentences: int = 1
    window_stride_sentences: int = 1
    max_candidates_lexical: int = 200
    max_candidates_embedding: int = 200
    max_candidates_total: int = 400
    max_citations_per_source: int = 2
    match_score: int = 2
    mismatch_score: int = -1
    gap_score: int = -1
    prefer_source_order: bool = True
    multi_span_evidence: bool = False
    multi_span_merge_gap_chars: int = 16
    multi_span_max_spans: int = 5

    @classmethod
    def strict(cls) -> CitationConfig:
        return cls(top_k=2, min_answer_coverage=0.4, supported_answer_coverage=0.7, min_final_score=0.3, max_citations_per_source=1)

    @classmethod
    def permissive(cls) -> CitationConfig:
        return cls(top_k=5, min_answer_coverage=0.15, supported_answer_coverage=0.4, allow_embedding_only=True, min_embedding_similarity=0.25, supported_embedding_similarity=0.5, max_citations_per_source=3)

    @classmethod
    def fast(cls) -> CitationConfig:
        return cls(top_k=1, max_candidates_lexical=50, max_candidates_embedding=50, max_candidates_total=100, max_citations_per_source=1)

    @classmethod
    def balanced(cls) -> CitationConfig:
        return cls()


@dataclass(frozen=True)
class HallucinationConfig:
    weak_citation_threshold: float = 0.4
    include_partial_in_grounded: bool = True


@dataclass(frozen=True)
class FactVerificationConfig:
    verified_coverage_threshold: float = 0.6
    partial_coverage_threshold: float = 0.3
    citation_config: CitationConfig | None = None

    def citations(self) -> CitationConfig:
        return self.citation_config or CitationConfig(top_k=3, min_answer_coverage=0.2, supported_answer_coverage=self.verified_coverage_threshold)

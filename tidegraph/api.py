"""The public names of the library."""

from dataclasses import dataclass, field

from .operators.agent import GraphRAGAgent, KnowledgeBaseAgent, benchmark
from .operators.chunking import ChunkingStrategyComparator, FixedSizeChunker, RecursiveChunker, SentenceChunker
from .operators.context import context
from .operators.build import GraphStore, build_graph, self_check
from .operators.linking import link_cases, link_entity
from .operators.report import report
from .operators.vectors import (
    EMBEDDING_PROVIDER_ENV,
    GEMINI_EMBEDDING_MODEL,
    LOCAL_EMBEDDING_MODEL,
    OPENAI_EMBEDDING_MODEL,
    EmbeddingStore,
    GeminiEmbedder,
    LocalEmbedder,
    MockEmbedder,
    OpenAIEmbedder,
)
from .operators.vectors import cosine as compute_similarity

_mock_embed = MockEmbedder()


@dataclass
class Document:
    id: str
    content: str
    metadata: dict = field(default_factory=dict)


def documents(spark, docs):
    """Documents as a DataFrame."""
    return spark.createDataFrame([(d.id, d.content, {k: str(v) for k, v in d.metadata.items()}) for d in docs], "id string, content string, metadata map<string,string>")


__all__ = [
    "Document", "documents", "FixedSizeChunker", "SentenceChunker", "RecursiveChunker", "ChunkingStrategyComparator", "compute_similarity", "EmbeddingStore",
    "KnowledgeBaseAgent", "GraphRAGAgent", "MockEmbedder", "LocalEmbedder", "OpenAIEmbedder", "GeminiEmbedder", "_mock_embed", "LOCAL_EMBEDDING_MODEL",
    "OPENAI_EMBEDDING_MODEL", "GEMINI_EMBEDDING_MODEL", "EMBEDDING_PROVIDER_ENV", "link_entity", "link_cases", "build_graph", "GraphStore", "self_check", "benchmark", "report", "context",
]

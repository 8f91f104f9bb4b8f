"""The registered queries; importing this package fills the registry."""

from stratamem.plans import graph_queries, insight_queries, memory_queries, search_queries  # noqa: F401

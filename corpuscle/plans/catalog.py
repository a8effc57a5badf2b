"""All registered queries."""

from corpuscle.plans.registry import QUERIES
from corpuscle.plans import q_text, q_index, q_retrieval, q_graph, q_mining, q_eval, q_sources  # noqa: F401  (importing registers)

__all__ = ["QUERIES"]

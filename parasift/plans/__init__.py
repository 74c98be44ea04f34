"""Query plans: the registered queries (with their SQL oracles) and the
end-to-end pipeline."""

from .registry import ORACLES, QUERIES


def load_all():
    """Import every query module so the registry is complete."""
    from . import q_batches, q_documents, q_exchange, q_flows, q_pages, q_rerank, q_store, q_summary, q_vectors  # noqa: F401

    return QUERIES, ORACLES

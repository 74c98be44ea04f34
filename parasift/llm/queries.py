"""Loads every query module of the subpackage."""

from .registry import ORACLES, QUERIES


def load_all():
    from . import (  # noqa: F401
        q_bpe, q_centroids, q_chat, q_decontaminate, q_exact_dedup, q_fixity, q_jaccard, q_langid, q_linefirst, q_pseudo, q_spelling,
        q_toxicity, q_wrapper,
    )

    return QUERIES, ORACLES

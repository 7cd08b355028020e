"""Votes on comparisons, read the same way by ranking (p3) and consensus (p6)."""

from acervo.operators.votes import LABELS, systems, valid_votes  # noqa: F401

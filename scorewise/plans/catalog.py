"""Every registered query (imports each query module for its side effect)."""

from scorewise.plans import q_decide, q_encode, q_features, q_io, q_evidence, q_models  # noqa: F401
from scorewise.plans.queries import REGISTRY

__all__ = ["REGISTRY"]

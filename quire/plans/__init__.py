"""Queries over the given tables: derived views, the registry, and one module per area."""

from quire.plans import corpus, extraction, latex, layout, operations, scores, streams, textops  # noqa: F401

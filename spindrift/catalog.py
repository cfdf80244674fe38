"""All core queries and their SQL oracles."""

from __future__ import annotations

from spindrift.plans import federated, metrics, quality, registry, rules, similarity, sources, text  # noqa: F401

QUERIES: dict = registry.QUERIES
ORACLES: dict = registry.ORACLES
COVERS: dict = registry.COVERS
FLAGSHIP = "j11_protected_containment"

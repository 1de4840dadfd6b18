from . import (
    dedup,
    documents,
    excerpts,
    extraction,
    notices,
    positions,
    reports,
    sets,
    verification,
)

__all__ = [
    "dedup",
    "documents",
    "excerpts",
    "extraction",
    "notices",
    "positions",
    "reports",
    "sets",
    "verification",
]

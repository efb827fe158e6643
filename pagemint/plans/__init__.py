"""Registered queries over the driver's tables."""


def load() -> tuple[dict, dict]:
    """Import the modules that register queries; returns the queries and their SQL."""
    from pagemint.plans import graded, pages, registry, verdicts  # noqa: F401

    return registry.QUERIES, registry.ORACLES

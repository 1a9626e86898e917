"""Key discovery for Spark tables."""

from keyloom.plans.discover import key_count, maximal_nonkeys, minimal_keys, verdicts

__all__ = ["key_count", "maximal_nonkeys", "minimal_keys", "verdicts"]

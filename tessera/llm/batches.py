"""Arrow batches in small slices: those of tessera.plans."""

from tessera.plans.batches import ROWS, small

__all__ = ["ROWS", "small"]

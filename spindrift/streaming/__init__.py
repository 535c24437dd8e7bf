"""Structured Streaming operators: state per key, the same kernels as in batch."""

from spindrift.streaming.stateful import block_counts, causal_filter, suppressed  # noqa: F401

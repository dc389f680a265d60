"""User-level compositions: inline, separate, batch and validate runs."""

from lakesync.plans.ingest import RunSummary, replay, run_batch, run_inline, run_separate, run_validate

__all__ = ["RunSummary", "replay", "run_batch", "run_inline", "run_separate", "run_validate"]

"""Composed plans: feature frames, validation and the full run."""

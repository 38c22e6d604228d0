"""Part of the evidence analytics package."""

"""Flow analytics: plans."""

"""Flow analytics: operators."""

"""Flow analytics: functions."""

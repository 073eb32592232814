"""Captures, saved runs, heavy-hitter texts, and tables built once a session."""

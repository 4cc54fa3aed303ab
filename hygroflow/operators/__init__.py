"""Reusable DataFrame operators; each returns a lazy plan."""

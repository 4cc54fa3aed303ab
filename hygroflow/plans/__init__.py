"""Whole analyses as lazy plans over the input tables."""

"""Readers and writers of the analyses' inputs and outputs."""

"""Romanization of streams."""

"""Queries over the projected state, each with its SQL."""

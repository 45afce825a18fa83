"""Readers and writers of edge lists, and graphs derived from tables."""

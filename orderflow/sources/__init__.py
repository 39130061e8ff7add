"""Readers, writers and the work-order view of the star-schema tables."""

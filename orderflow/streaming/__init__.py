"""Structured Streaming jobs over phase events and order documents."""

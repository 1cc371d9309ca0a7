"""Readers, adapters and writers of the engine's tables."""

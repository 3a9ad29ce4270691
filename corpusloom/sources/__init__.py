"""Readers, writers, versioned index storage and shared scratch space."""

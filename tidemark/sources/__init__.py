"""Readers, writers, manifests and the normalisers of provider frames."""

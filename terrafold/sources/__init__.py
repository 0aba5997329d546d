"""Readers and writers of frames, labels, manifests, captions and caches."""

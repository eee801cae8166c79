"""Detectors: forests on features, networks on sequences and graphs."""

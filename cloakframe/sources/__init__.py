"""Readers and writers: wide and long tables, xlsx packages, encrypted containers, manifests."""

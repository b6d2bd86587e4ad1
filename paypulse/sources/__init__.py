"""Readers of topics and layers."""

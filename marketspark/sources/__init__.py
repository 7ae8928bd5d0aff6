"""Loaders, fixture adapters, wire records, quote and news sources, connectors."""

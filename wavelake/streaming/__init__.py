"""Structured Streaming versions of windowed and recursive operators."""

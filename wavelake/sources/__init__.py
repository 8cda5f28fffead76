"""Readers of word tables, audio and models."""

"""Readers and writers of bar panels."""

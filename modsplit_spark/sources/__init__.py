"""Readers, sinks, fixture views and the shared work folder."""

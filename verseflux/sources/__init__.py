"""Readers and writers: text collections, CSV tables, media listings, waveforms."""

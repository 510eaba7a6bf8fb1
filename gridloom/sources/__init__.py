"""Readers and writers: label lines, class lists, JSON summaries, image headers."""

"""Incremental versions of the evaluation over file streams."""

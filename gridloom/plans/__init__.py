"""Registered queries: derived fixture views, query plans and their reference SQL."""

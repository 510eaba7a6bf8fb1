"""Column builders without state: box geometry, vectors, text."""

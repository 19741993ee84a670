"""Column functions: null-safe arithmetic, text, vectors, spectral indices, surface and energy terms."""

"""Column helpers: value semantics, text primitives, hashes."""

"""Column expressions: text, identifiers, dates, age bands, hashing, paths, labels."""

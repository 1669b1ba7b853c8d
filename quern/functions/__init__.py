"""Column functions: names, citations, identifiers, vectors."""

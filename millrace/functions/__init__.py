"""Column expressions: extractors, transforms, predicates and times."""

"""Column functions: text, paths, lists, identifiers and scores."""

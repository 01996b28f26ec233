"""Column functions: text features, windows, snippets, terms."""

"""Column functions over source text, names, paths and signatures. All are built-in expressions: none runs Python on rows."""

"""Column functions: texts, HTML, references, vectors."""

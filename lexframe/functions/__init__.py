"""Column functions over text: folds, citations, references, dates, similarity."""

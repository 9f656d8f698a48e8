"""Column functions: identifiers, dates, safe arithmetic, and probabilities that Spark lacks."""

"""lexframe: legal-text and legislation-register analytics on Spark DataFrames."""

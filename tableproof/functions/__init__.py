"""Column builders: names, canonical row text, digests. No Python UDF anywhere."""

"""Column functions: text normalisation, similarities, keys, parsers."""

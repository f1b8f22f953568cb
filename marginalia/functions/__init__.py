"""Column functions: text, quantities, citations."""

"""Column functions: text rules, cleaning, classification, parsing."""

"""Column functions: ratio rules, text forms, sequences and distributions."""

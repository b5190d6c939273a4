"""Options and whole plans built from the operators."""

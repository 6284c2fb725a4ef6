"""Training-data operators: one module each, imported by nothing else in the library."""

"""Column functions: octants and their relations, space-filling curves, bits and points."""

"""Column functions and batch kernels for text, tokens and alignment."""

"""Answers as a stream: each micro-batch is aligned against a static corpus; groundedness rolls over event time."""

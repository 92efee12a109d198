"""Training-data operators: ten corpus jobs, each with its registered query."""

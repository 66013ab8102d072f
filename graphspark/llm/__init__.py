"""Training-data operators: ten corpus operators, each with its query and SQL."""

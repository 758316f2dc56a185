"""Training-data operators: one module for each, plus the queries over them."""

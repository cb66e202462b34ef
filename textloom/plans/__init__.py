"""A tokenizer as a declarative plan: stages that compile to Column expressions."""

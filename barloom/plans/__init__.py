"""The registered queries, by family, each with its SQL."""

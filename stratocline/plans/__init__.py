"""Complete queries, composed from the operators."""

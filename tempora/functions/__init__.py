"""Column-expression functions (no UDFs): text normalisation, tokenisation and
typed access to nested JSON reports."""

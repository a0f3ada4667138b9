"""Document parsers and the registered queries."""

"""The registered queries over the operators, with their SQL."""

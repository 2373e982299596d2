"""The registered corpus queries."""

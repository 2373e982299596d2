"""DataFrame operators over the ledger."""

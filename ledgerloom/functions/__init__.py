"""Part of the ledger analytics engine."""

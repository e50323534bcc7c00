"""Ledger analytics on Spark: operators, plans and queries over payment ledgers."""

"""Packets back to captures, and the ledger of runs."""

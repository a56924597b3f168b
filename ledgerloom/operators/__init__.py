"""Batch operators over the transaction state."""

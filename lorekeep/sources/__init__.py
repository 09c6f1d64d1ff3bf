"""Batches, the snapshot store, proposals and the audit log."""

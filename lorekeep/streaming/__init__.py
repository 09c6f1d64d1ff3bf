"""The inbox: batches as a stream."""

"""Mutation logs, replayed in batches or applied as a stream."""

"""Streaming forms of the main figures. Each has a batch operator as its truth."""

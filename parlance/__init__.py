"""Conversation retrieval on DataFrames: transcripts to chunks, hybrid search, context rendering."""

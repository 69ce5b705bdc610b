"""The stateful online semantics on Structured Streaming."""

"""Runnable jobs: `python -m jobs.track_moves ...`, `python -m jobs.request_batches ...`."""

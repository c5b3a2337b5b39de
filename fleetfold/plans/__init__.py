"""Whole jobs, from feeds to summaries. Each returns lazy tables; writing is the caller's choice."""

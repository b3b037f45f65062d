"""Recordings as streams: stateful filters, running statistics, buckets and sessions."""

"""Composed pipelines, the query catalog and its SQL counterparts."""

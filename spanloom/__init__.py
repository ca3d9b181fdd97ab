"""Span-relational text engine on Spark: documents in, spans as rows, masked text and audit tables out."""

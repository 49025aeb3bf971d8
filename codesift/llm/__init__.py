"""Operators for preparing training data: documents in, documents, spans, links or files out."""

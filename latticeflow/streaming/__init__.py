"""Incremental ingestion and resumable stages. The data has no event time, so there are no watermarks or stream windows."""

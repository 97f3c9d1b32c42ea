"""millrace: Spark jobs for record-ingestion pipelines."""

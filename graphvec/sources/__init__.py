"""Files in and out: stores of collections, payload JSON, document ingestion."""

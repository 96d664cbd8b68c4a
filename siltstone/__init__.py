"""Content analytics over DataFrames of documents, pages and other byte content."""

"""lexweave: legal-document knowledge tables as PySpark jobs."""

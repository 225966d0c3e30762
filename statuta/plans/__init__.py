"""Plans that compose operators: search, questions, document analysis, ingest; and the driver's queries."""

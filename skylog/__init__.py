"""Radio contact-log analytics as Spark jobs: ingest, enrich, merge, map and count."""

__version__ = "0.1.0"

"""Tender intelligence and document evidence as Spark jobs."""

"""Lamella: layered document retrieval and ledger analytics as Spark jobs."""

"""Sablefin: PII detection, reversible tokenisation, profiling and scoring, written for Spark."""

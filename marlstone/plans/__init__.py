"""Orchestration on the driver: checks, the lake, and the ingestion run. All rows stay on the executors."""

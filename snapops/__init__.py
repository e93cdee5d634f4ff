"""Backup-catalog and cluster-ring analytics as PySpark DataFrame jobs."""

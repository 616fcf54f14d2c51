"""Part of strandmill."""

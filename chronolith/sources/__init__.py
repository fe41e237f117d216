"""Readers: parquet tables, git repositories, directory trees, dependency manifests."""

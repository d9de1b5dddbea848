"""Operators over events, features, snapshots and scores."""

"""Posting triage as Spark jobs: extract, classify, score, qualify, store, report."""

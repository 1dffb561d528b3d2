"""Relational operators: detection, tokenisation, context risk, audit chains and their rollups,
attestation, evaluation, drift of schemas, shredding of nested records, increments."""

"""Operators for preparing training data: packing, filters, scores, fingerprints and near-duplicates."""

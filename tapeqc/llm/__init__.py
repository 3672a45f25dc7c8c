"""Training-data operators: mixing, search, language ID, archives, scans, packing and near-duplicate joins."""

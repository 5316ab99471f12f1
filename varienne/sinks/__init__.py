"""Writers: designs, results, manifests and report tables."""

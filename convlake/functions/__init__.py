"""Scalar functions: columns in, columns out, all native."""

"""Scalar kernels: fingerprints and distances as Columns, pixel kernels in numpy."""

"""Functions that need Python: Unicode normalisation and signatures, by Arrow batches."""

"""Operators of a training-data pipeline. Nothing outside imports this subpackage but the driver's entry module, which can do without."""

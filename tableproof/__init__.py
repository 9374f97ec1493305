"""tableproof: prove that copies of data are what they claim to be, on Spark."""

__version__ = "0.1.0"

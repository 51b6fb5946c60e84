"""Data work of open-domain question answering as PySpark DataFrame functions."""

"""Robustness analytics for text detectors, written as Spark DataFrame operators.

Layout
    functions/   column expressions (text, URL, HTML, hashing)
    operators/   DataFrame -> DataFrame building blocks
    sources/     readers and writers
    plans/       user-facing reports composed from the operators
    streaming/   incremental ingest of rewrite records
"""

__version__ = "0.1.0"

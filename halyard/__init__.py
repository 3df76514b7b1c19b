"""halyard: a Spark-first analytics library for ticket-like records and their text."""

__version__ = "0.1.0"

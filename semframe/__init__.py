"""semframe: semantic dataflow operators over text, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"

"""recordscope: composite record layouts recovered from access facts, as Spark DataFrame operators."""

__version__ = "0.1.0"

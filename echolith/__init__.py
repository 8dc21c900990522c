"""echolith: audio containers, codecs and sample math as Spark DataFrames."""

__version__ = "0.1.0"

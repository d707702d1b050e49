"""outcomelens: outcome-and-price analysis of wide record tables as Spark jobs."""

__version__ = "0.1.0"

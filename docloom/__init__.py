"""Document-corpus analytics and hybrid retrieval as Spark table jobs."""

__version__ = "0.1.0"

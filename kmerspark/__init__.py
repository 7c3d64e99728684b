"""k-mer and de Bruijn graph work as Spark DataFrame jobs."""

__version__ = "0.1.0"

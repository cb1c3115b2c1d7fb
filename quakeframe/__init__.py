"""quakeframe: analytics over uniformly sampled signals and their metadata, as Spark plans."""

__version__ = "0.1.0"

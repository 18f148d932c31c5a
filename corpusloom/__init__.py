"""corpusloom: builds AI-readable site corpora from web-crawl archives on Spark."""

from corpusloom.options import BuildOptions

__all__ = ["BuildOptions"]

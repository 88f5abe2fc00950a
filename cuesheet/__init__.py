"""Timeline analytics on Spark: captions, frames, figures, decks and run logs as DataFrames."""

__version__ = "0.1.0"

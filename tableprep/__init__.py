"""tableprep: table and text preparation, model choice, tuning and ensembling on Spark."""

__version__ = "0.1.0"

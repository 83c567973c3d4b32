"""quillgrid: document-QA analytics as Spark logical plans."""

__version__ = "0.1.0"

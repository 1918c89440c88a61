"""graphmill: source-code graph analytics and large-scale data operators on PySpark."""

__version__ = "0.1.0"

"""Sources and sinks."""

from .synthetic import synthetic
from .tables import Tables, generate, load, save

__all__ = ["Tables", "generate", "load", "save", "synthetic"]

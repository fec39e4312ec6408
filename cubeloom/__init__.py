"""Labelled multidimensional arrays ("data cubes") as Spark DataFrames."""

from .cube import Attr, Cube
from .dims import Dim, Dimensions

__all__ = ["Attr", "Cube", "Dim", "Dimensions"]

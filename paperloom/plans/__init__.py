"""Registered queries: importing the modules fills the registry."""

from . import corpus, retrieval  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

"""Driver queries of the library, one for each operator, with DuckDB SQL beside them."""

from . import curation, entities, evaluation, names, profiling, retrieval, texts  # noqa: F401

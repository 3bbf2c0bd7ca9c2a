"""Named procedures: a registry of functions from a graph and arguments to a DataFrame; YIELD is a select."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.graph import Graph, SemanticError

_KNOWN: dict[str, Callable[..., DataFrame]] = {}


def procedure(name: str):
    def keep(f: Callable[..., DataFrame]):
        _KNOWN[name] = f
        return f

    return keep


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Adds a procedure of the caller's: a function from a graph and arguments to a DataFrame."""
    _KNOWN[name] = f


def call(graph: Graph, name: str, *args, yields: list[str] | None = None) -> DataFrame:
    if name not in _KNOWN:
        raise SemanticError(f"no procedure {name}")
    out = _KNOWN[name](graph, *args)
    return out.select(*yields) if yields else out


def game_phase(board: Column) -> Column:
    """The phase of a chess position by the letters of its text: up to 10 endgame, up to 24 middlegame, else opening."""
    n = F.char_length(F.regexp_replace(board, "[^A-Za-z]", ""))
    return F.when(n <= 10, "endgame").when(n <= 24, "middlegame").otherwise("opening")


@procedure("db.labels")
def _labels(graph: Graph) -> DataFrame:
    return graph.labels()


@procedure("db.relationshipTypes")
def _types(graph: Graph) -> DataFrame:
    return graph.spark.createDataFrame([(t,) for t in graph.relationship_types()], "type string")


@procedure("db.index.vector.queryNodes")
def _nearest(graph: Graph, label: str, key: str, k: int, vector: list[float]) -> DataFrame:
    """The k nodes with the largest cosine similarity to a vector."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    found = vectors.top_k(graph.nodes[label].df, vectors.cosine(F.col(key), asked), k, "id")
    return found.select("id", "score")

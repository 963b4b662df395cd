"""Questions to a graph: seeds by BM25 and named anchors, their neighbours, the prompt, and a completion where one is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loomspark.config import Config
from loomspark.operators.retrieval import Bm25Retriever, Retriever, expanded, leaks, prompt
from loomspark.sources import artifacts
from loomspark.sources.cells import VectorRetriever

SYSTEM = "Answer from the numbered context blocks only and cite the anchor of each block that you use. Blocks marked NOT IN FORCE do not apply: say so. If the context has no answer, say that the graph has none."


class ScopeError(ValueError):
    """A graph that this caller may not ask."""


#: Retrievers by name; each is made from units and what it needs besides (an index, a function that embeds).
RETRIEVERS: dict[str, Callable[..., Retriever]] = {"bm25": Bm25Retriever, "vector": lambda units, index, embed, probes=None: VectorRetriever(index, embed, probes)}


def retriever_of(name: str, units: DataFrame | None, **needs) -> Retriever:
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}: one of {sorted(RETRIEVERS)}")
    return RETRIEVERS[name](units, **needs)


def checked_scope(path: str, units: DataFrame, config: Config, internal: bool = False) -> str:
    """The target that the artifact at path declares. A restricted one is refused unless internal is set; so is one that
    declares none, or an unknown one, and holds sources of a scope that no public target emits."""
    scope = artifacts.declared_scope(path)
    names = {n for t in config.targets if t.exposure != "public" for n in (t.id, *t.aliases)}
    restricted = scope in names
    if not restricted:
        open_scopes = {s for t in config.targets if t.exposure == "public" for s in t.scopes}
        prefixes = [f"{config.root}/{s}/" for s in config.scopes if s not in open_scopes]
        restricted = bool(prefixes) and leaks(units, prefixes, "uid", 1).count() > 0
    if restricted and not internal:
        raise ScopeError(f"the graph is of a restricted target ({scope or 'undeclared'})")
    return scope or ("restricted" if restricted else "unknown")


def ask(units: DataFrame, question: str, limit: int = 5, budget: int = 12, meta: dict | None = None, restricted: list[str] | None = None, retriever: Retriever | None = None, complete: Callable[[str, str], str] | None = None) -> str:
    """The prompt, or what complete(system, prompt) answers. Units of a restricted scope stop it."""
    if restricted and leaks(units, restricted, "uid", 1).count():
        raise ValueError("the graph holds what this scope may not see")
    own = None if retriever else Bm25Retriever(units)
    hits = expanded(units, (retriever or own).retrieve(question, limit), budget)
    text = prompt(units, hits, question, SYSTEM, meta or {}).first().prompt
    if own:
        own.close()
    return complete(SYSTEM, text) if complete else text

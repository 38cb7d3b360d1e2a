"""Pluggable embedders and completers. Remote models plug in as classes of their own; those here need no network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import in_batches
from .text import terms


class Embedder(Protocol):
    """Turns a text column into a column array<double>. A remote model returns a pandas UDF over Arrow batches."""

    dimension: int

    def embed(self, text: Column) -> Column: ...


def embedded(text: Column, by: Embedder) -> Column:
    """The vector of a text; a blank text is handed to every embedder as one blank, which remote models take."""
    return by.embed(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(" ")).otherwise(text))


class HashingEmbedder:
    """Counts of a text's terms, hashed with signs to `dimension` places and normalised. An expression: no Python runs.

    Blank texts embed as one blank, that is as the zero vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, text: Column) -> Column:
        n = self.dimension
        # Signed places: 1..n and -1..-n, from the first eight hex digits of a digest and the parity of the ninth.
        place = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % n + 1) * (1 - 2 * (F.conv(F.substring(F.md5(w), 9, 1), 16, 10).cast("long") % 2))
        places = F.transform(terms(text), place)
        counts = F.aggregate(places, F.array_repeat(F.lit(0.0), n), lambda a, p: F.transform(a, lambda x, i: x + F.when(i + 1 == F.abs(p), F.signum(p)).otherwise(0.0)))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        # The counts are bound once as the only element of an array, so that they aren't worked out for every place.
        return F.transform(F.array(counts), lambda v: F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm(v), n).alias("s")), lambda z: F.when(z["s"] > 0, z["x"] / z["s"]).otherwise(0.0)))[0]


class Completer(Protocol):
    """Answers prompts: one reply for each, None for a call that failed."""

    def complete(self, prompts: list[str]) -> list[str | None]: ...


class OverlapCompleter:
    """A deterministic stand-in for a model. Prompts are JSON with a `task`: it summarises by the first sentence, and finds
    nodes relevant by the share of the query's terms in their titles and summaries."""

    @staticmethod
    def _share(query: str, text: str) -> float:
        words = lambda s: set(re.findall("[a-z0-9]+", s.lower()))
        return round(len(words(query) & words(text)) / max(1, len(words(query))), 2)

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self._one(json.loads(p)) for p in prompts]

    def _one(self, p: dict) -> str | None:
        task = p.get("task")
        if task == "summary":
            return "Summary: " + (p.get("content") or "").strip().split(". ")[0][:200]
        if task in ("candidates", "select"):
            found = [{"node_id": n["node_id"], "relevance": self._share(p["query"], f"{n.get('title') or ''} {n.get('summary') or ''}")} for n in p["nodes"]]
            found = [n for n in found if n["relevance"] > 0]
            return json.dumps({"candidates" if task == "candidates" else "selected_nodes": found})
        if task == "decompose":
            parts = [s.strip() for s in p["query"].replace("?", " and ").split(" and ") if s.strip()]
            return json.dumps({"is_complex": len(parts) > 1, "sub_questions": parts})
        if task == "relevance":
            share = self._share(p["query"], p.get("content") or "")
            return json.dumps({"thinking": "terms shared", "relevant": share >= 0.5, "confidence": share, "reason": "terms shared"})
        if task == "verify":
            share = self._share(p["query"], p.get("content") or "")
            return json.dumps({"contains_answer": share >= 0.5, "answer_type": "direct" if share >= 0.5 else "none", "key_information": "", "confidence": share})
        if task == "markdown":
            # As a model does at times, it fences what it returns; pages without text it can't convert.
            words = re.sub(r"<[^>]*>", " ", p.get("content") or "").split()
            return "```markdown\n# " + (p.get("title") or "") + "\n\n" + " ".join(words) + "\n```" if words else None
        if task == "answer":
            return (p.get("context") or "")[:500]
        return None


class RecordedCompleter:
    """Replies from a mapping of prompts, None for others: for tests and for replaying earlier calls."""

    def __init__(self, replies: dict[str, str | None]):
        self.replies = replies

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self.replies.get(p) for p in prompts]


COMPLETERS: dict[str, Callable[..., Completer]] = {"overlap": OverlapCompleter, "recorded": RecordedCompleter}
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder}


def register_completer(name: str, make: Callable[..., Completer]) -> None:
    COMPLETERS[name] = make


def register_embedder(name: str, make: Callable[..., Embedder]) -> None:
    EMBEDDERS[name] = make


def completer(name: str = "overlap", **options) -> Completer:
    if name not in COMPLETERS:
        raise ValueError(f"no completer {name!r}; register_completer() adds one")
    return COMPLETERS[name](**options)


def embedder(name: str = "hashing", **options) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; register_embedder() adds one")
    return EMBEDDERS[name](**options)


def completed(prompts: DataFrame, by: Completer, prompt: str = "prompt", into: str = "reply") -> DataFrame:
    """prompts with a column of replies, asked batch by batch. Of a batch that raises, prompts are asked one by one; one that
    raises alone gets a null reply (unanswered() counts them): each operator says what it does without one. Replies of a
    real model should be written to a table before they are used twice."""

    def alone(text: str) -> str | None:
        try:
            return by.complete([text])[0]
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b[prompt].tolist()
            try:
                replies = by.complete(asked)
            except Exception:  # noqa: BLE001
                replies = [alone(x) for x in asked]
            yield b.drop(columns=into, errors="ignore").assign(**{into: pd.Series(replies, index=b.index, dtype=object)})

    return in_batches(prompts).mapInPandas(run, T.StructType([f for f in prompts.schema.fields if f.name != into] + [T.StructField(into, T.StringType())]))


def unanswered(replied: DataFrame, reply: str = "reply") -> DataFrame:
    """One row: prompts, and those of them that have no reply."""
    return replied.agg(F.count("*").alias("prompts"), F.count_if(F.col(reply).isNull()).alias("unanswered"))


def strict_json(body: Column) -> Column:
    """The JSON of a reply, keys in order; null for what doesn't parse as a whole, or else from its first { to its last }."""

    def whole(text: Column) -> Column:
        # The parser leaves alone what follows a value: between brackets, it must be the only one.
        read = F.try_variant_get(F.try_parse_json(F.concat(F.lit("[["), text, F.lit("]]"))), "$", "array<array<variant>>")
        return F.when((F.size(read) == 1) & (F.size(F.get(read, F.lit(0))) == 1), F.to_json(F.get(F.get(read, F.lit(0)), F.lit(0))))

    return F.coalesce(whole(body), whole(F.regexp_extract(body, r"(?s)\{.*\}", 0)))

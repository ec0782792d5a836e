"""Plug-in points: model-backed extraction and grounding over any client and grounder.

Models run inside ``mapInPandas``: a factory makes one client per worker, so nothing that cannot be pickled travels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetry.functions import text

EXTRACTION = (
    "Reply with plain lines, one statement of fact to a line, each ending in a full stop, without numbering or comments. A reader who sees only that line "
    "must understand it, so name what it is about. Prefer the wording of the source: lines with other vocabulary are thrown away. No line for what asks, commands or guesses."
)


class Client(Protocol):
    def complete(self, prompt: str, system: str | None = None) -> str: ...


class Grounder(Protocol):
    def supports(self, source: str, claim: str) -> bool: ...


def complete_all(rows: DataFrame, key: str, prompt: str, make_client: Callable[[], Client], system: str | None = None) -> DataFrame:
    """Rows (key, reply); the reply is null where the client fails, so that one failure empties no document."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(p: str | None) -> str | None:
            try:
                return None if p is None else client.complete(p, system)
            except Exception:  # noqa: BLE001 - any failure of a connector means the fallback
                return None

        for f in frames:
            yield pd.DataFrame({key: f[key], "reply": [ask(p) for p in f[prompt]]})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string")


def model_claims(rows: DataFrame, key: str, make_client: Callable[[], Client], make_grounder: Callable[[], Grounder] | None = None) -> DataFrame:
    """Rows (key, pos, claim): claims a model extracts from ``text``, kept only where the text's vocabulary bears them out.

    Without a reply the rules decide. A grounder, if given, judges only what passes the vocabulary check."""
    replies = complete_all(rows, key, "text", make_client, EXTRACTION)
    both = rows.select(key, "text").join(replies, key)
    listed = text.let(F.col("text"), lambda t: F.filter(text.reply_claims(F.col("reply")), lambda c: text.grounded_in(c, t)))
    found = both.select(key, "text", F.posexplode(F.when(F.col("reply").isNull(), text.claims(F.col("text"))).otherwise(listed)).alias("pos", "claim"))
    if make_grounder is None:
        return found.select(key, "pos", "claim")
    kind = rows.schema[key].dataType.simpleString()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grounder = make_grounder()
        for f in frames:
            yield f[[grounder.supports(t, c) for t, c in zip(f["text"], f["claim"])]][[key, "pos", "claim"]]

    return found.mapInPandas(judge, f"{key} {kind}, pos int, claim string")

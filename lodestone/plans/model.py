"""Calls to a language model, as a table operation with an injected client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Takes system and user texts and a temperature; gives the HTTP status (0: no connection) and the text.
Client = Callable[[str, str, float], tuple[int, str]]


def offline(system: str, user: str, temperature: float) -> tuple[int, str]:
    """The default: no model, an empty reply."""
    return 200, ""


def ask(client: Client, system: str, user: str, temperature: float = 0.3, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[bool, str]:
    """The reply, or an empty text after ``tries``. No connection, 429 and 5xx are tried again, other refusals are not."""
    for n in range(tries):
        try:
            status, text = client(system, user, temperature)
        except OSError:
            status, text = 0, ""
        if 200 <= status < 300:
            return True, text or ""
        if status and status != 429 and status < 500:
            break
        if n + 1 < tries:
            wait(0.5 * 2**n)
    return False, ""


def replies(prompts: DataFrame, client: Client = offline, temperature: float = 0.3, tries: int = 3) -> DataFrame:
    """Adds ok and reply to key, system, user; a failed call is a row, not a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [ask(client, s or "", u or "", temperature, tries) for s, u in zip(f["system"], f["user"], strict=True)]
            yield f.assign(ok=[t[0] for t in told], reply=[t[1] for t in told])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in prompts.schema)
    return prompts.mapInPandas(run, f"{schema}, ok boolean, reply string")


@dataclass(frozen=True)
class Provider:
    """Where a client sends its calls."""

    key: str
    model: str
    endpoint: str
    group: str = ""

    def available(self) -> bool:
        return bool(self.key)


def provider(env: Mapping[str, str], first: str = "LLM", fallback: str = "FALLBACK") -> Provider:
    """The first service if it has a key, else the other as it is: a missing key never leaves both unused."""
    name = first if env.get(f"{first}_API_KEY") else fallback
    of = lambda what: env.get(f"{name}_{what}", "")
    return Provider(of("API_KEY"), of("MODEL"), of("ENDPOINT"), "" if name == first else of("GROUP_ID"))

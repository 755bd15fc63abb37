"""Steps that need a model or an engine outside: interfaces, and stubs that work offline and give the same result each time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Client(Protocol):
    """A language model: one text in, one text out."""

    def __call__(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def __call__(self, text: str) -> list[float]: ...


def echo_client(prompt: str) -> str:
    """A stub: an empty graph, fenced like a model's answer."""
    return '```json\n{"synthesis": {"nodes": [], "edges": []}}\n```'


def hashed_embedder(dim: int = 64) -> Embedder:
    """A stub: character three-grams hashed to a unit vector; blank text gives no vector."""

    @lru_cache(1 << 17)
    def place(gram: str) -> tuple[int, int]:
        h = int.from_bytes(hashlib.md5(gram.encode()).digest()[:8], "big")
        return h % dim, 1 if h >> 63 else -1

    def embed(text: str) -> list[float]:
        t = f"  {text.strip().lower()} "
        v = np.zeros(dim)
        for i in range(len(t) - 2):
            at, sign = place(t[i : i + 3])
            v[at] += sign
        n = np.linalg.norm(v)
        return (v / n).tolist() if n and text.strip() else []

    return embed


def ask(texts: DataFrame, make_client: Callable[[], Client], key: str = "run_id", prompt: str = "text", retries: int = 1) -> DataFrame:
    """Answers of a model: key, answer, error. The client is made once a task; a failing row gets its error, the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            rows = []
            for k, p in zip(b[key], b[prompt], strict=True):
                answer, error = None, None
                for _ in range(max(1, retries)):
                    try:
                        answer, error = client(p), None
                        break
                    except Exception as e:  # a model's failure belongs to its row
                        error = f"{type(e).__name__}: {e}"
                rows.append((k, answer, error))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, error string")


def embed(texts: DataFrame, make: Callable[[], Embedder], key: str, text: str) -> DataFrame:
    """Vectors of texts: key, embedding; blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [(f(t) or None) if t else None for t in b[text]]})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>").where("embedding is not null")


#: Providers of models and the setting that holds each one's key.
PROVIDER_KEYS = {"openai": "OPENAI_API_KEY", "deepseek": "DEEPSEEK_API_KEY", "google": "GOOGLE_API_KEY"}
_MAKERS: dict[str, Callable[..., Client]] = {"stub": lambda model, **_: echo_client}


def provider(name: str, make: Callable[..., Client]) -> None:
    """Registers a maker of clients: ``make(model, **options)``."""
    _MAKERS[name.lower()] = make


def model_parts(name: str) -> tuple[str, str]:
    """Provider and model of a name such as ``provider_model``: lower case, parted at the first underscore."""
    head, _, rest = name.strip().lower().partition("_")
    if not head or not rest:
        raise ValueError(f"a model's name is provider_model, not {name!r}")
    return head, rest


def get_model(name: str, **options) -> Client:
    """A client by its model's name; the options go to the provider's maker as they are."""
    head, rest = model_parts(name)
    if head not in _MAKERS:
        raise ValueError(f"no provider {head!r}; known are {sorted(_MAKERS)}")
    return _MAKERS[head](rest, **options)


def key_setting(name: str) -> str | None:
    """The setting that must hold a key for this model; none for providers without one."""
    return PROVIDER_KEYS.get(model_parts(name)[0])


def list_models(fetch: Callable[[], list[str]]) -> list[str]:
    """Models that a provider offers, sorted; none if it can't be asked."""
    try:
        return sorted(fetch())
    except Exception:
        return []


def prompts(texts: DataFrame, template: str, key: str = "run_id", **columns: str) -> DataFrame:
    """Prompts from a template: key, text. Each ``{NAME}`` of ``columns`` is replaced literally; lists come in as JSON; other braces stay."""
    from pyspark.sql import functions as F

    out = F.lit(template)
    for name, column in columns.items():
        kind = dict(texts.dtypes)[column]
        value = F.to_json(column) if kind.startswith(("array", "map", "struct")) else F.col(column).cast("string")
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return texts.select(key, out.alias("text"))


def embed_cached(texts: DataFrame, cache: DataFrame, make: Callable[[], Embedder], text: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of distinct texts by the md5 of the stripped text, and the rows to add to the cache: (md5, embedding) each. Cached texts are not sent again."""
    from pyspark.sql import functions as F

    asked = texts.where(F.trim(text) != "").select(F.trim(text).alias("t")).distinct().withColumn("md5", F.md5("t"))
    known = cache.select("md5", "embedding").dropDuplicates(["md5"])
    fresh = embed(asked.join(known.select("md5"), "md5", "left_anti"), make, "md5", "t")
    return asked.select("md5").join(known, "md5").unionByName(fresh), fresh


def extract(texts: DataFrame, make_client: Callable[[], Client], stages: dict[str, tuple[str, str]], key: str = "run_id", retries: int = 1) -> DataFrame:
    """Answers of each stage and its critique: key, stage, answer, patch, error.

    ``stages`` gives each stage's template and that of its critique, with
    ``{ARTICLE_TEXT}``, ``{CATALYST_IDS}`` (those of the first stage, as JSON) and,
    in the critique, ``{ANSWER}``.  Stages run in the order given; what a failed
    one lacks is null.
    """
    from pyspark.sql import functions as F

    from weft.functions import text as X
    from weft.session import cut

    base, out = texts.withColumn("ids", F.lit("[]")), None
    for n, (stage, (first, second)) in enumerate(stages.items()):
        said = cut(ask(prompts(base, first, key, ARTICLE_TEXT="text", CATALYST_IDS="ids"), make_client, key, "text", retries))
        both = base.join(said.select(key, "answer"), key)
        patch = cut(ask(prompts(both.where("answer is not null"), second, key, ARTICLE_TEXT="text", CATALYST_IDS="ids", ANSWER="answer"), make_client, key, "text", retries))
        rows = said.join(patch.select(key, X.fenced(F.col("answer"), "json").alias("patch")), key, "left").select(key, F.lit(stage).alias("stage"), "answer", "patch", "error")
        out = rows if out is None else out.unionByName(rows)
        if n == 0:
            ids = said.select(key, F.to_json(F.array_distinct(F.regexp_extract_all("answer", F.lit(r'"catalyst_tested_ids"\s*:\s*\[([^\]]*)\]'), 1))).alias("found"))
            ids = ids.select(key, F.concat(F.lit("["), F.coalesce(F.get_json_object("found", "$[0]"), F.lit("")), F.lit("]")).alias("ids"))
            base = cut(texts.join(ids, key, "left").withColumn("ids", F.coalesce("ids", F.lit("[]"))))
    return out

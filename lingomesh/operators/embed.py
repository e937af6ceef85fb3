"""Embeddings from text columns or page content.

The embedding model is a user-supplied batch function ``fn(list[str]) -> list[vector]``
(any model, local or remote).  Spark does the data work around it:

* one cache key per row (``sha1(model|base_url|text)``), computed natively;
* distinct keys only (``dropDuplicates``), minus the keys already in a cache table
  (``left_anti``) — identical texts are requested once;
* the misses are spread over ``parallelism`` tasks and sent in batches of ``batch_size``
  by ``mapInPandas``; a failing batch marks its own rows, other batches go on; a fatal
  error (bad endpoint, refused key) in the first batch, which is sent alone, stops the run;
* the results are written once (reliable checkpoint: a lost executor never re-requests
  vectors), fanned out to every row by a join on the key, and offered as new cache rows.

A text repeated on a third of all rows is one key: it is requested once, and the fan-out
join is a hash join whose skewed side Spark's adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.text import build_text, col_of
from ..session import cut_lineage
from ..sources.cache import KeyedCache
from .quality import CrawlColumns, row_filter_reason, sets_from_vectors

EMBED_SCHEMA = "key string, vector array<float>, error string"


class EmbeddingError(Exception):
    """An error of one batch request; only that batch's rows are marked."""


class FatalEmbeddingError(EmbeddingError):
    """An error every batch would hit (endpoint, key, path); the run stops."""


class RetryableError(EmbeddingError):
    """A passing error (rate limit, overload, network): the batch is asked again after a wait."""


class TextTooLongError(EmbeddingError):
    """The endpoint refused the batch because a text is too long (HTTP 400)."""


def cache_key(text: Column | str, model: str = "", base_url: str = "") -> Column:
    """``sha1(model|base_url|text)`` as hex (X11); the API key is not part of it."""
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(base_url), col_of(text)))


def text_stats(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts, mean characters and estimated tokens over the non-empty texts."""
    t = F.col(text_col)
    ok = t.isNotNull() & (t != "")
    return texts.agg(
        F.count_if(ok).alias("texts"),
        F.floor(F.coalesce(F.sum(F.when(ok, F.length(t))), F.lit(0)) / F.greatest(F.count_if(ok), F.lit(1))).alias("avg_chars"),
        F.floor(F.coalesce(F.sum(F.when(ok, F.length(t))), F.lit(0)) / 4).alias("tokens"),
    )


def sha1_embedder(dim: int = 8) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic test model: the first ``dim`` bytes of ``sha1(text)`` divided by 255 (K3)."""

    def fn(texts: list[str]) -> list[list[float]]:
        return [[b / 255.0 for b in hashlib.sha1(t.encode("utf-8")).digest()[:dim]] for t in texts]

    return fn


def _as_vector(v) -> list[float] | None:
    """A returned vector as a flat float32 list; ``[]`` marks a shape the set builder rejects."""
    try:
        arr = np.asarray(v, dtype=np.float32)
    except (TypeError, ValueError):
        return []
    if arr.ndim != 1 or arr.size == 0:
        return []
    return arr.tolist()


def _answer(fn, texts: list[str]) -> list:
    """The vectors of one request; an answer of the wrong length is an error of the batch."""
    vectors = list(fn(texts))
    if len(vectors) != len(texts):
        raise EmbeddingError(L.EMBED_WRONG_COUNT.format(len(vectors), len(texts)))
    return vectors


def _call(fn, texts: list[str], max_chars: int | None) -> tuple[list | None, str | None]:
    """One batch: vectors, or an error text for all its rows.  If the endpoint refuses the texts
    as too long, they are sent once more, each cut to half the limit (without a limit: to half of
    the longest text).  A fatal error is raised."""
    limit = max_chars or max(map(len, texts), default=1)
    attempts = [texts, [t[: max(1, limit // 2)] for t in texts]]
    for last, attempt in enumerate(attempts):
        try:
            return _answer(fn, attempt), None
        except Exception as e:  # noqa: BLE001 - one broken batch never stops the others
            if is_fatal(e):
                raise e if isinstance(e, FatalEmbeddingError) else FatalEmbeddingError(str(e)) from e
            if last or isinstance(e, EmbeddingError) and not isinstance(e, TextTooLongError) or not _too_long(e):
                return None, str(e)
    return None, None


def _too_long(e: Exception) -> bool:
    return isinstance(e, TextTooLongError) or bool(re.search(L.TEXT_TOO_LONG, str(e), re.I))


FATAL_MARK = "\x00fatal:"


def is_fatal(e: Exception) -> bool:
    """Whether every later batch would meet the same error (K2): a refused key or path, a missing
    endpoint (HTTP 401, 403, 404 in ``status``), or a retry that was used up."""
    return isinstance(e, FatalEmbeddingError) or getattr(e, "status", None) in (401, 403, 404)


def _with_retries(fn, waits: Sequence[float]):
    """``fn`` that waits and asks again on a :class:`RetryableError`; when the waits are used up the
    error is fatal."""
    def call(texts: list[str]):
        for wait in (*waits, None):
            try:
                return fn(texts)
            except RetryableError as e:
                if wait is None:
                    raise FatalEmbeddingError(str(e)) from e
                time.sleep(wait)
        return None

    return call


def _batcher(fn, batch_size: int, max_chars: int | None, probe: bool = False, waits: Sequence[float] = L.EMBED_WAITS):
    prefix = L.DROP_EMBED_FAILED.replace("{}", "")
    asked = _with_retries(fn, waits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, texts = pdf["key"].tolist(), pdf["text"].tolist()
            for i in range(0, len(texts), batch_size):
                kb, tb = keys[i:i + batch_size], texts[i:i + batch_size]
                try:
                    vecs, err = _call(asked, tb, max_chars)
                    err = None if err is None else prefix + err
                except FatalEmbeddingError as e:
                    vecs, err = None, FATAL_MARK + str(e) if probe else prefix + str(e)
                vectors = [None] * len(kb) if err is not None else [_as_vector(v) for v in vecs]
                yield pd.DataFrame({"key": kb, "vector": vectors, "error": [err] * len(kb)})

    return run


@dataclass
class Embedded:
    rows: DataFrame        # input rows + key, vector, error
    new_cache: DataFrame   # key, vector of the vectors computed in this run

    def dimension(self) -> int | None:
        """Length of the vectors (A14): that of the run's first one by key."""
        row = self.rows.where("vector IS NOT NULL").agg(F.min_by(F.size("vector"), "key").alias("d")).first()
        return row["d"]


def append_cache(cache_path: str, new_cache: DataFrame) -> None:
    """Add the vectors of a run to a cache table (S10); only keys it does not hold yet."""
    KeyedCache(new_cache.sparkSession, cache_path).append(new_cache.select("key", "vector"))


def read_cache(spark, cache_path: str) -> DataFrame:
    """A cache table as :func:`embed_texts` takes it: one vector per key, empty before the first append."""
    return KeyedCache(spark, cache_path, "vector array<float>").read()


def embed_texts(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[str]], Sequence],
    *,
    model: str = "",
    base_url: str = "",
    cache: DataFrame | None = None,
    batch_size: int = L.EMBED_BATCH_SIZE,
    max_chars: int | None = None,
    parallelism: int | None = None,
) -> Embedded:
    """Vector or error for every row of ``df`` with a non-empty ``text_col``.

    ``cache``: ``key string, vector array<float>`` from earlier runs; hits cost no request.
    ``parallelism`` bounds the number of concurrent batch calls (tasks).
    """
    spark = df.sparkSession
    # the output columns replace input columns of the same names
    keyed = df.drop(*[c for c in ("key", "vector", "error") if c in df.columns and c != text_col])
    keyed = keyed.withColumn("key", cache_key(text_col, model, base_url))
    distinct = keyed.select("key", F.col(text_col).alias("text")).dropDuplicates(["key"])
    misses = distinct if cache is None else distinct.join(cache.select("key"), "key", "left_anti")
    n = parallelism or spark.sparkContext.defaultParallelism
    # one batch first, on its own: an endpoint that refuses every request stops the run here,
    # before any task has asked it; later fatal errors only mark the rows of their batch
    first = cut_lineage(misses.orderBy("key").limit(batch_size).coalesce(1).mapInPandas(_batcher(fn, batch_size, max_chars, probe=True), EMBED_SCHEMA))
    fatal = first.where(F.col("error").startswith(FATAL_MARK)).select("error").limit(1).collect()
    if fatal:
        raise FatalEmbeddingError(fatal[0]["error"].removeprefix(FATAL_MARK))
    later = misses.join(first.select("key"), "key", "left_anti")
    computed = cut_lineage(first.unionByName(
        later.repartition(n, "key").mapInPandas(_batcher(fn, batch_size, max_chars), EMBED_SCHEMA)))
    results = computed
    if cache is not None:
        results = computed.unionByName(cache.select("key", "vector", F.lit(None).cast("string").alias("error")))
    rows = keyed.join(results, "key", "left")
    return Embedded(rows=rows, new_cache=computed.where(F.col("error").isNull()).select("key", "vector"))


def embed_in_slices(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[str]], Sequence],
    cache_path: str,
    *,
    slices: int = 16,
    model: str = "",
    base_url: str = "",
    **embed_kw,
) -> Embedded:
    """:func:`embed_texts` in ``slices`` parts of the distinct keys, each committed to the cache at
    ``cache_path`` when it is done (K1, S10).

    A run that dies, by a fatal answer or a lost driver, is simply started again: finished slices
    are hits, only the open one and those after it are asked for.  Texts that failed are asked for
    again, too.  ``new_cache`` holds what this run computed; null and empty texts get no vector.
    """
    cache = KeyedCache(df.sparkSession, cache_path, "vector array<float>")
    usable = df.where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    key = cache_key(text_col, model, base_url)
    asked = cut_lineage(usable.select(F.col(text_col).alias("text"), key.alias("key")).dropDuplicates(["key"]))
    before, errors = cut_lineage(cache.read().select("key")), []
    for part in range(slices):
        todo = asked.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == part)
        todo = todo.join(cache.read().select("key"), "key", "left_anti").select("text")
        run = embed_texts(todo, "text", fn, model=model, base_url=base_url, **embed_kw)
        cache.append(run.new_cache)
        errors.append(run.rows.where(F.col("error").isNotNull()).select("key", F.lit(None).cast("array<float>").alias("vector"), "error"))
    stored = cache.read()
    results = stored.withColumn("error", F.lit(None).cast("string"))
    for e in errors:
        results = results.unionByName(e)
    keyed = df.drop(*[c for c in ("key", "vector", "error") if c in df.columns and c != text_col]).withColumn("key", key)
    return Embedded(rows=keyed.join(results, "key", "left"), new_cache=stored.join(before, "key", "left_anti"))


def texts_for_rows(df: DataFrame, cols: CrawlColumns, text_cols: list[str], max_chars: int | None = None,
                   filter_indexable: bool = True) -> DataFrame:
    """``code, pos, text, error`` of the rows kept by the row filter."""
    kept = df.where(row_filter_reason(cols, filter_indexable).isNull())
    text = build_text([F.col(f"`{c}`") for c in text_cols], max_chars)
    return kept.select(
        col_of(cols.code).alias("code"), col_of(cols.pos).alias("pos"), text.alias("text"),
        F.when(text == "", F.lit(L.DROP_NO_TEXT)).alias("error"),
    )


def sets_from_texts(
    df: DataFrame,
    cols: CrawlColumns,
    texts: DataFrame,
    fn: Callable[[list[str]], Sequence],
    filter_indexable: bool = True,
    **embed_kw,
) -> tuple[DataFrame, DataFrame, Embedded]:
    """Language sets whose vectors are computed from texts (K4, L2).

    ``texts``: ``code, pos, text, error`` (from :func:`texts_for_rows` or the page source).
    Raises ``EmbeddingError`` when texts exist but not one vector came back.
    """
    # texts feed two branches (embedding, error rows) and may carry an expensive text
    # expression (page extraction): compute them once; this also keeps filters from being
    # pushed into, and duplicating, that expression
    texts = texts.persist(StorageLevel.MEMORY_AND_DISK)
    todo = texts.where(F.col("error").isNull() & (F.col("text") != ""))
    emb = embed_texts(todo, "text", fn, **embed_kw)
    got = emb.rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vector").isNotNull()).alias("ok"),
                       F.first(F.col("error"), ignorenulls=True).alias("err")).first()
    if got["n"] > 0 and got["ok"] == 0:
        raise EmbeddingError(got["err"] or L.EMBED_NOTHING)
    vectors = emb.rows.select("code", "pos", "vector", "error").unionByName(
        texts.where(F.col("error").isNotNull()).select("code", "pos", F.lit(None).cast("array<float>").alias("vector"), "error")
    )
    valid, dropped = sets_from_vectors(df, cols, vectors, filter_indexable)
    return valid, dropped, emb

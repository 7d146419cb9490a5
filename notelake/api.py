"""Search, resolve and get over a corpus with an index; building the index; embedders (IDX-01..04, UDF-01..07).

An embedder is a function from a list of texts to a list of vectors; embed_with() runs it over Arrow batches, so it may be any model that the
executors can load. hashing_embedder() needs none: it is deterministic and offline.
"""

from __future__ import annotations

import concurrent.futures
import datetime
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import retrieval
from notelake.sources import corpus as C
from notelake.sources import index, shared

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 64  # texts that an embedder gets at once
MAX_K = 20

#: The providers, with the models that they use by default.
PROVIDERS = {"openai": "text-embedding-3-small", "ollama": "nomic-embed-text"}


@dataclass
class Provider:
    name: str
    model: str
    url: str | None = None


def provider_of(settings: dict[str, str], auto: bool = False) -> Provider | None:
    """Which provider texts such as environment variables ask for: the named one, else openai if there is a key, else, with auto, ollama.

    EMBED_PROVIDER, EMBED_MODEL, API_KEY and URL are read, all with the prefix NOTELAKE_. openai without a key is none.
    """
    get = lambda k: (settings.get(f"NOTELAKE_{k}") or "").strip()
    named = get("EMBED_PROVIDER").lower()
    name = named if named in PROVIDERS else "openai" if get("API_KEY") else "ollama" if auto else ""
    if not name or (name == "openai" and not get("API_KEY")):
        return None
    return Provider(name, get("EMBED_MODEL") or PROVIDERS[name], get("URL") or ("http://localhost:11434" if name == "ollama" else None))


def hashing_embedder(width: int = 256) -> Embedder:
    """Words and pairs of neighbouring words, hashed to signed components; vectors of length 1, or of zeros for a text without words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts):
            words = text.lower().split()
            for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = zlib.crc32(gram.encode("utf-8", "surrogatepass"))
                row[h % width] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()

    return embed


def in_order(answer: list) -> list:
    """Vectors in the order of their texts: an answer of {index, embedding} objects, or of vectors that are in order already."""
    if not answer or not isinstance(answer[0], dict):
        return answer
    if sorted(a["index"] for a in answer) != list(range(len(answer))):
        raise ValueError("the embedder's answer has indices twice or none for a text")
    return [a["embedding"] for a in sorted(answer, key=lambda a: a["index"])]


def patient(embedder: Embedder, timeout_s: float, retries: int = 0, pause_s: float = 0.5) -> Embedder:
    """An embedder that is asked again, after a pause that doubles, when it fails or takes too long; the last failure is raised."""

    def ask(texts: list[str]) -> list:
        for n in range(retries + 1):
            pool = concurrent.futures.ThreadPoolExecutor(1)
            try:
                return pool.submit(embedder, texts).result(timeout_s)
            except Exception:
                if n == retries:
                    raise
                time.sleep(pause_s * 2**n)
            finally:
                pool.shutdown(wait=False)

    return ask


def embed_with(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, embedding) of (id, text), BATCH texts at a time. A malformed answer, of another length than was asked for, is an error."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, values = batch.column("id"), [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(values), BATCH):
                asked = values[at : at + BATCH]
                got = in_order(embedder(asked))
                if len(got) != len(asked):
                    raise ValueError(f"the embedder gave {len(got)} vectors for {len(asked)} texts")
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(asked)), pa.array(got, pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


def build_index(notes: DataFrame, folder: str, embedder: Embedder, provider: str, model: str) -> dict[str, int]:
    """Bring the index in a folder up to date with notes (id, name, description, body, mtime in ms as long).

    Notes that the index has with the same mtime are left alone; new and changed ones are embedded; those that are gone are removed. Counts
    of all notes, embedded, removed, skipped. An index of another provider or model is an error.
    """
    spark = notes.sparkSession
    kind = notes.schema["id"].dataType.simpleString()
    held = index.read(spark, folder, provider, model) if index.manifest(spark, folder) else spark.createDataFrame([], f"id {kind}, mtime long, model string, embedding array<float>")
    new, gone = index.changes(held, notes.select("id", "mtime"))
    texts = notes.join(new.select("id"), "id", "left_semi").select("id", T.embed_input(F.col("name"), F.col("description"), F.col("body")).alias("text"))
    fresh = shared.written(embed_with(texts, embedder).join(new, "id").select("id", "mtime", F.lit(model).alias("model"), "embedding"), "fresh")
    removed, embedded, total = gone.count(), fresh.count(), notes.count()
    m = index.manifest(spark, folder)
    width = index.check_width(fresh, m["width"] if m else None)
    if embedded or removed or not m:
        index.write(shared.written(index.upsert(index.remove(held, gone), fresh), "index"), folder, provider, model, width)
    return {"total": total, "embedded": embedded, "removed": removed, "skipped": total - embedded}


def semantic_search(queries: DataFrame, notes: DataFrame, folder: str, embedder: Embedder, provider: str, model: str, k: int, cache: str | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """(qid, id, sim01, rank) of the k nearest notes for each query (qid, prompt); ids that no note has are dropped after ranking.

    Without an index there are no rows. With a folder for the cache, prompts that were asked before aren't embedded again; the cache is
    touched, filled, cut to its capacity and written.
    """
    spark = queries.sparkSession
    if not index.manifest(spark, folder):
        return spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, id {notes.schema['id'].dataType.simpleString()}, sim01 double, rank int")
    held = index.read(spark, folder, provider, model)
    asked = queries.where("prompt is not null").select("qid", "prompt")
    now = now or datetime.datetime.now()
    kind = "prompt_sha string, model string, embedding array<float>, accessed_at timestamp"
    versions = f"{cache}/versions" if cache else None
    last = spark.read.parquet(versions).agg(F.max("n")).first()[0] if cache and shared.exists(spark, versions) else 0
    old = index.cache_open(spark.read.schema(kind).parquet(f"{cache}/v{last}"), model) if last else spark.createDataFrame([], kind)
    found, touched = index.cache_get(old, asked, model, now)
    found = shared.written(found, "cached")
    missing = found.where("embedding is null").select("prompt").distinct()
    fresh = shared.written(embed_with(missing.select(F.col("prompt").alias("id"), F.col("prompt").alias("text")), embedder).withColumnRenamed("id", "prompt"), "asked")
    if cache:
        index.cache_put(touched, fresh, now, model).write.parquet(f"{cache}/v{last + 1}")
        spark.createDataFrame([(last + 1,)], "n long").coalesce(1).write.mode("append").parquet(versions)
    vectors = found.join(fresh.withColumnRenamed("embedding", "fresh"), "prompt", "left").select("qid", F.coalesce("embedding", "fresh").alias("embedding"))
    return retrieval.topk(vectors, held, k, model).join(notes.select("id"), "id", "left_semi").select("qid", "id", "sim01", "rank")


def summary(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """hits with what a caller sees of each note: id, name, description (empty if there is none) and path."""
    return hits.join(notes.select("id", "name", F.coalesce("description", F.lit("")).alias("description"), "path"), "id")


def search(notes: DataFrame, query: str, similar: Callable[[DataFrame, int], DataFrame], k: int = 5) -> DataFrame:
    """(id, name, description, path, score) of the k (1 to 20) notes nearest to a query; similar(queries, k) is a search such as semantic_search."""
    if not query or not 1 <= k <= MAX_K:
        raise ValueError(f"a query, and from 1 to {MAX_K} hits")
    asked = notes.sparkSession.createDataFrame([(0, query)], "qid long, prompt string")
    found = summary(similar(asked, k), notes)
    return found.orderBy("rank").select("id", "name", "description", "path", F.col("sim01").alias("score"))


def resolve(notes: DataFrame, prompt: str, similar: Callable[[DataFrame, int], DataFrame] | None = None, tool: str | None = None, command: str | None = None, floor: float = 0.5, max_hits: int = 5, weights=None, vocabulary: dict = C.VOCABULARY) -> DataFrame:
    """(id, name, description, path, gate, score, reason) of the notes that a prompt, and perhaps a tool call, brings up."""
    spark = notes.sparkSession
    asked = spark.createDataFrame([(0, prompt, tool, command)], "qid long, prompt string, tool_name string, tool_command string")
    w = weights or retrieval.Weights()
    kind = notes.schema["id"].dataType.simpleString()
    near = similar(asked, retrieval.candidates(max_hits, w.k)) if similar else spark.createDataFrame([], f"qid long, id {kind}, sim01 double, rank int")
    tools = retrieval.tool_gate(asked, notes) if tool else None
    hits = retrieval.blend(asked, notes, near, floor, max_hits, w, tools, vocabulary)
    return summary(hits, notes).orderBy("rank").select("id", "name", "description", "path", "gate", "score", "reason")


def get(notes: DataFrame, id_: str) -> dict:
    """A note by its id, with or without .md; one that isn't there is an answer, not an error."""
    name = id_[:-3] if id_.lower().endswith(".md") else id_
    rows = notes.where(F.col("id").cast("string") == name).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else {"error": "not_found", "id": name}


def corpus(spark: SparkSession, folder: str, now: datetime.datetime | None = None) -> DataFrame:
    """A folder's accepted notes as search and resolve take them: mtime in ms, age in days (0 where it isn't known), an order."""
    at = F.lit(now) if now else F.current_timestamp()
    rows = C.load(spark, folder)
    age = F.coalesce((F.unix_millis(at.cast("timestamp")) - F.unix_millis("mtime")) / 86_400_000, F.lit(0.0))
    return rows.withColumn("age_days", age).withColumn("mtime", F.unix_millis("mtime"))

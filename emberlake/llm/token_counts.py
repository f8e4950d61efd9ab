"""Token counts from a cache keyed by the digests of contents and of the tokenizer; only distinct misses are encoded."""
from __future__ import annotations

import hashlib
import json
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, texts_of
from .exact_dedup import large
from .kernels import lean
from .quotient import bitmap, hit
from .workspace import Workspace, shared_dir

SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def bytes_of_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Counter:
    """Counts as the tokenizers library does for a byte-level .json file, special strings included; tests hold them equal. Files that ask for anything else are refused."""

    def __init__(self, path: str, pattern: str):
        with open(path) as f:
            spec = json.load(f)
        refused = unlike(spec)
        if refused:
            raise ValueError(f"{path}: no plain byte-level BPE: {', '.join(refused)}")
        letters = bytes_of_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.pattern, self.special = pattern, special
        self.fast = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=special)
        self.slow: Encoder | None = None

    def count(self, text: str) -> int:
        try:
            return len(self.fast.encode(text, allowed_special="all"))
        except ValueError:  # the library's matcher gives up on very long runs of white space
            self.slow = self.slow or Encoder(self.ranks, self.pattern)
            parts = regex.split("|".join(map(regex.escape, self.special)), text) if self.special else [text]
            return len(parts) - 1 + sum(map(len, self.slow.encode(parts)))


def unlike(spec: dict) -> list[str]:
    """What a tokenizer file asks for that the counter doesn't do."""
    model, found = spec["model"], []
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback"):
        found.append("model")
    if spec.get("normalizer"):
        found.append("normalizer")
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        found.append("pre_tokenizer")
    if spec.get("truncation") or spec.get("padding"):
        found.append("truncation or padding")
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec["added_tokens"]):
        found.append("added_tokens")
    # merges in the order of ids: then a pair's rank is the id of what it makes
    ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:])):
        found.append("merges")
    return found


@lean
def _counted(batches, path: str, pattern: str):
    count = Counter(path, pattern).count
    for batch in batches:
        for rows, texts in texts_of(batch):
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("content")), pa.array(np.array([count(t) for t in texts], np.int64))], ["content", "n_tokens"])


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(SCHEMA).parquet(cache)
    return spark.createDataFrame([], SCHEMA)


def token_counts(docs: DataFrame, path: str, pattern: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; repeated rows each get theirs.

    A content is the text with null as empty; nothing else is normalised, as the tokenizer normalises
    nothing. Its SHA-256 and the tokenizer file's are the key. Contents that the cache lacks are encoded
    once each and appended to it. cache: a Parquet folder that all executors share; None takes that of
    the cluster's shared folder, which later calls find again. An empty table gives no rows; extra
    columns play no part.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "token-counts")
    cache = cache or default_cache(spark)
    version = tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = work.save(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content")))
    contents = work.save(rows.groupBy("content").agg(F.count(F.lit(1)).alias("times")))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("content").distinct()
    misses = work.save(contents.join(known, "content", "left_anti"))
    if not misses.isEmpty():
        fp = F.xxhash64("content")
        # texts whose content is certainly known stay out; those that occur once stay where they are; only possible copies are shuffled
        missing = bitmap(misses.select(fp.alias("fp")), repeated=False)
        repeated = bitmap(misses.where("times > 1").select(fp.alias("fp")), repeated=False)
        wanted = docs.select(text.alias("text"), digest.alias("content")).where(hit(fp, missing))
        wanted = wanted.withColumn("again", hit(fp, repeated))
        once = wanted.where(~F.col("again")).select("content", "text")
        copies = wanted.where("again").groupBy("content", "text").count().select("content", "text")
        made = once.unionByName(copies).mapInArrow(partial(_counted, path=path, pattern=pattern), "content binary, n_tokens long")
        made = made.join(misses.select("content"), "content", "left_semi")
        made.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = work.save(contents.join(stored, "content"))
    # rows of contents that very many have meet their count where they are
    hot = F.broadcast(large(counts, "times", rows.count()))
    joined = rows.join(hot, "content").unionByName(rows.join(hot, "content", "left_anti").join(counts, "content"))
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_cache(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-count-cache"

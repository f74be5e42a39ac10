"""Operator 5: token counts of documents in flat token files, by separator scan.

A token file is a plain run of little-endian identifiers, each document closed by the end-of-document identifier, with no
index. Files are read in blocks; in each block a vector comparison finds the separators. Documents that cross block borders
are stitched by a prefix scan over the blocks of a file: the number of separators before a block numbers its documents, and
the last separator before it is where its first document began. Only one short row per block takes part in the scan.

`write_token_files` makes such files from documents with a public byte-level BPE vocabulary; text that spells a special token
is ordinary text, so the separator never occurs inside a document. Null and empty texts have 0 tokens; repeated rows are
documents of their own; tokens after the last separator of a file are an open document; an odd byte at the end of a file is
no token. Empty tables and folders give empty results. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxlake.llm.common import bounded, scratch, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR, WIDTH = 50256, 2
BLOCK_TOKENS = 1 << 20


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Writes a token file for each partition and returns (file, ordinal, doc_id): which documents a file holds, in order.

    A task writes under a name of its own and renames at its end, so a repeated task replaces its file as a whole."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        system, folder = file_system(path)
        task, n = TaskContext.get(), 0
        system.create_dir(folder, recursive=True)
        name = f"{folder}/tokens-{task.partitionId():06d}.bin"
        own = f"{folder}/_{task.partitionId():06d}-{task.taskAttemptId()}-{os.getpid()}"
        with system.open_output_stream(own) as file:
            for pdf in batches:
                for text in pdf.text:
                    ids = [] if text is None else encode(text)
                    ids.append(separator)
                    file.write(np.array(ids, dtype=f"<u{width}").tobytes())
                yield pd.DataFrame({"file": task.partitionId(), "ordinal": np.arange(n, n + len(pdf)), "doc_id": pdf.doc_id})
                n += len(pdf)
        if n:
            system.move(own, name)
        else:
            system.delete_file(own)

    bounded(docs.sparkSession)
    manifest = docs.select("doc_id", "text").mapInPandas(written, "file int, ordinal long, doc_id long")
    return stored(manifest, "manifest")


def block_summaries(spark: SparkSession, path: str, separator: int, width: int, block_tokens: int) -> DataFrame:
    """(file, block, tokens, n, first, last, inner): per block its separators' number, first and last place in the file,
    and the lengths of the documents that lie between them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(path).select("path", "length")
    blocks = (
        files.withColumn("tokens", F.floor(F.col("length") / width))
        .where("tokens > 0")
        .select(
            F.regexp_extract("path", r"tokens-(\d+)\.bin$", 1).cast("int").alias("file"), "path", "tokens",
            F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block_tokens}"))).alias("block"),
        )
        .repartition(F.col("file"), F.col("block"))
    )

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                start = r.block * block_tokens
                n = min(block_tokens, r.tokens - start)
                system, name = file_system(r.path)
                with system.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(n * width, start * width), dtype=f"<u{width}")
                at = np.flatnonzero(ids == separator) + start
                yield pd.DataFrame({
                    "file": [r.file], "block": [r.block], "tokens": [r.tokens], "n": [len(at)],
                    "first": [at[0] if len(at) else -1], "last": [at[-1] if len(at) else -1], "inner": [np.diff(at) - 1],
                })

    return blocks.mapInPandas(scanned, "file int, block long, tokens long, n long, first long, last long, inner array<long>")


def document_lengths(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the token files of a folder."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        block_summaries(spark, path, separator, width, block_tokens)
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("since", F.coalesce(F.max("last").over(before), F.lit(-1)))
    )
    closed = stitched.where("n > 0").select(
        "file", "base", F.posexplode(F.concat(F.array(F.expr("first - since - 1")), F.col("inner"))).alias("place", "n_tokens")
    )
    final = stitched.where(f"block = (tokens - 1) div {block_tokens}").select(
        "file", F.expr("base + n").alias("ordinal"), F.expr("tokens - greatest(since, last) - 1").alias("n_tokens"), F.lit(False).alias("closed")
    )
    done = closed.select("file", F.expr("base + place").alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    return done.unionByName(final.where("n_tokens > 0"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) of every row, counted in the token files that the documents are written to."""
    path = scratch(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, path, vocabulary)
    lengths = document_lengths(docs.sparkSession, path, block_tokens=block_tokens)
    return manifest.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")

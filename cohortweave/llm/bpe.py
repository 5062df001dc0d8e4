"""Byte-level BPE encoding and decoding with a local rank file (operator 7).

The tiktoken library encodes; texts are cut first at boundaries that no match of the pattern crosses:

* before a space that follows a character other than white space (every alternative takes a space only at its start);
* around runs of white space that are too long for the library's regex stack.  Such a run gives one match without its
  last character when something follows, or the whole run at the end of the text, so it is encoded as that one piece.

Ids of the parts concatenate to the ids of the whole text.  The rank file is read on the driver and broadcast: its size is
checked against ``MAX_RANK_BYTES``.

Edge cases: a null text is an empty one (0 tokens, empty bytes); repeated rows and null ids give one row each; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortweave.llm.common import text_steps

MAX_RANK_BYTES = 64 << 20
PART_CHARS = 1 << 16
LONG_RUN = 1024
# The characters of \s in the library's regex.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[^{SPACES}] ")
_RUN = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")


class Codec:
    """An encoder for whole texts from the lines of a rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is one match, part) in order."""
        at = 0
        if len(text) > LONG_RUN:
            for run in _RUN.finditer(text):
                yield from ((False, p) for p in self._cut(text, at, run.start()))
                at = run.end() if run.end() == len(text) else run.end() - 1
                yield True, text[run.start():at]
        yield from ((False, p) for p in self._cut(text, at, len(text)))

    @staticmethod
    def _cut(text: str, at: int, end: int) -> Iterator[str]:
        while end - at > PART_CHARS:
            found = _CUT.search(text, at + PART_CHARS, end)
            if not found:
                break
            yield text[at:found.end() - 1]
            at = found.end() - 1
        if at < end:
            yield text[at:end]

    def ids(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, one for each part of the text."""
        for single, part in self.parts(text):
            yield self.encoding._core_bpe.encode_single_piece(part.encode()) if single else self.encoding.encode_ordinary(part)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    key = (hash(lines), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(lines, pattern)
    return _codecs[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        lines = f.read(MAX_RANK_BYTES + 1)
    if len(lines) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: a rank file has {MAX_RANK_BYTES} bytes at most")
    return lines


def encode(docs: DataFrame, rank_path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` but one named as ``ids``, and ``ids``: array<int>.

    Rows leave a task in batches of about a million characters, so a batch of long texts needs little memory.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [c for c in docs.columns if c != ids]
    fields = [docs.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in text_steps(texts):
                parts = [np.concatenate([np.zeros(0, np.int32), *(np.asarray(p, dtype=np.int32) for p in codec.ids(t))]) for t in texts[a:b]]
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                columns = [batch.column(k).slice(a, b - a) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*kept, ids])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return source.mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, rank_path: str, pattern: str, *, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """All columns of ``encoded`` but one named as ``out``, and ``out``: the raw bytes of the ids (null ids: empty)."""
    held = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [c for c in encoded.columns if c != out]

    @F.pandas_udf("binary")
    def to_bytes(lists: pd.Series) -> pd.Series:
        codec = _codec(held.value, pattern)
        return pd.Series([codec.encoding.decode_bytes(list(x)) for x in lists])

    return encoded.select(*[F.col(f"`{c}`") for c in kept], to_bytes(F.coalesce(F.col(ids), F.array().cast("array<int>"))).alias(out))


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, of ids encoded and decoded part by part.

    The ids and bytes of a text are hashed as they arise, so a very long text needs the memory of one part.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(held.value, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, joined, raw = 0, hashlib.sha256(), hashlib.sha256()
                for part in codec.ids(text or ""):
                    joined.update(((" " if n else "") + " ".join(map(codec.decimal.__getitem__, part))).encode())
                    raw.update(codec.encoding.decode_bytes(part))
                    n += len(part)
                rows.append((n, joined.hexdigest(), raw.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = narrow.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))

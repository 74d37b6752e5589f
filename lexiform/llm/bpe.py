"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiform.llm.common import documents, shielded, slices

#: Texts longer than this many characters are cut at safe boundaries before they are encoded.
LONG = 1 << 16
#: White space between two characters that aren't.
LONE = regex.compile(r"(?<=\S)\s(?=\S)")

_ENCODERS: dict = {}


def encoder(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file's bytes; one a worker process. No special tokens."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        names = [str(i) for i in range(max(table.values()) + 1)]
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={}), names
    return _ENCODERS[key]


def safe_parts(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` in parts of about ``long`` characters whose separate encodings join to that of the whole.

    With the pattern of the public rank files a match always starts at a single white-space character between two
    others that aren't white space: what stands before it can't reach over it, and it opens the next match or is one
    of its own. Parts are cut before such a character only; a stretch without one stays whole. White space is what the pattern's ``\\s`` takes,
    which U+001C to U+001F aren't.
    """
    start, n = 0, len(text)
    while n - start > long:
        at = start + long
        lone = LONE.search(text, at)
        if lone is None:
            break
        at = lone.start()
        yield text[start:at]
        start = at
    yield text[start:]


def encode(text: str, enc, long: int = LONG) -> list[int]:
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, long) for i in enc.encode_ordinary(part)]


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, ranks: bytes, pattern: str, ids: bool = False, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256 and decoded_sha256 (and ids where asked for).

    A null text is encoded as an empty one (no tokens). Whole texts are encoded; the ids are decoded to raw bytes,
    which for any text are its UTF-8. Every row gives one row, equal texts equal values; an empty table gives an empty result. The rank file's bytes are
    broadcast (under 1 MB). Columns of ``docs`` named like the new ones are replaced.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    docs, back = shielded(docs, (text,), new)
    keep = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(*shared.value)
        for b in slices(batches):
            n, a, d, all_ids = [], [], [], []
            for t in b.column(b.num_columns - 1):
                got = encode(t.as_py() or "", enc)
                n.append(len(got))
                a.append(hashlib.sha256(" ".join([names[i] for i in got]).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
                if ids:
                    all_ids.append(got)
            more = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *([pa.array(all_ids, pa.list_(pa.int32()))] if ids else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *more], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])

    out = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))
    return back(docs.select(*keep, text).mapInArrow(run, out).withColumn(text, F.lit(None))).drop(text)


def decoded(tokens: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``tokens`` with column ids replaced by ``bytes``: the raw bytes of the ids, which need not be valid UTF-8. Null ids give null."""
    keep = [c for c in tokens.columns if c != "ids"]
    shared = tokens.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(*shared.value)
        for b in slices(batches):
            raw = [None if x.as_py() is None else enc.decode_bytes(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(raw, pa.binary())], [*keep, "bytes"])

    return tokens.select(*keep, "ids").mapInArrow(run, tokens.select(*keep).schema.add("bytes", "binary"))


def public_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    return rank_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; nulls and odd rows as in ``encoded``."""
    return encoded(documents(spark, sf_dir).select("doc_id", "text"), *public_ranks())

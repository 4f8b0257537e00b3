"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read on the driver and sent as a broadcast (about 1 MB, independent of the data); each Python
worker builds its encoder once. Long texts are cut before encoding at safe boundaries: between an ASCII letter, digit
or mark and a following space or line feed. No match of the split pattern reaches over such a place, because white space
stands only at the start of a match, so the ids are those of the whole text. A long run of white space, which the pattern's
lookahead can't get through, is one match up to its last character (or to its end, at the end of the text) and goes to the merges directly.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; rows are independent, so
repeated rows and ties need no rule; an empty table gives an empty table; other columns are kept where asked for, and a new column whose
name is taken gets an underscore.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name

#: Texts of more characters than this are encoded in pieces.
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"[0-9A-Za-z.,;:!?)](?=[ \n])")
#: White space as the pattern has it (Python's \\s has four separators more), and the length from which a run is a piece of its own.
LONG_RUN = 1000
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN, _PAIR = re.compile(f"{_BLANK}{{{LONG_RUN},}}"), re.compile(_BLANK + "{2}")
_ENCODERS: dict = {}


def encoder(ranks_file: bytes, pattern: str):
    """The tiktoken encoder of a rank file's bytes; kept for the life of the process."""
    key = (hash(ranks_file), pattern)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[key] = (enc, [str(i) for i in range(max(ranks.values()) + 1)])
    return _ENCODERS[key]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """text in consecutive pieces, each cut at the first safe boundary at or after size characters."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size - 1)
        if not found:
            break
        out.append(text[at : found.end()])
        at = found.end()
    out.append(text[at:])
    return out


def runs(text: str) -> list[tuple[str, bool]]:
    """text in consecutive parts: those that are one match of white space, and the others."""
    # A long run covers two samples that follow each other.
    if len(text) < LONG_RUN or not _PAIR.search(text[:: LONG_RUN // 2]):
        return [(text, False)]
    out, at = [], 0
    for m in _RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += [(text[at : m.start()], False), (text[m.start() : end], True)]
        at = end
    return [*out, (text[at:], False)]


def encode(enc, text: str, size: int = PIECE_CHARS) -> list[int]:
    ids: list[int] = []
    for part, blank in runs(text):
        if blank:
            ids += enc._encode_single_piece(part)
        else:
            for piece in pieces(part, size):
                ids += enc.encode_ordinary(piece)
    return ids


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes; they need not be valid UTF-8 when ids are cut inside a character."""
    return enc.decode_bytes(ids)


def bpe_tokenize(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids: bool = True, digests: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns in keep (all by default), n_tokens, and where asked token_ids and the digests of ids and of the decoded bytes."""
    spark: SparkSession = df.sparkSession
    bounded_batches(spark)
    with open(rank_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    keep = df.columns if keep is None else keep
    kept = df.select(*[f"`{c}`" for c in keep]).schema
    inner = fresh_name(keep, "_text")
    added = [("n_tokens", T.LongType(), pa.int64())]
    added += [("token_ids", T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32()))] * ids
    added += [(c, T.StringType(), pa.string()) for c in ("ids_sha256", "decoded_sha256")] * digests
    names_of = {c: fresh_name(keep, c) for c, _, _ in added}
    schema = T.StructType(list(kept.fields) + [T.StructField(names_of[c], t) for c, t, _ in added])

    def run(batches):
        enc, names = encoder(ranks.value, pattern)
        for batch in batches:
            made: dict[str, list] = {c: [] for c, _, _ in added}
            for value in batch.column(inner):
                tokens = encode(enc, value.as_py() or "")
                made["n_tokens"].append(len(tokens))
                if ids:
                    made["token_ids"].append(tokens)
                if digests:
                    made["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in tokens]).encode()).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(decode(enc, tokens)).hexdigest())
            old = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(old + [pa.array(made[c], t) for c, _, t in added], names=keep + [names_of[c] for c, _, _ in added])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text_col}` AS `{inner}`").mapInArrow(run, schema)

"""Token ids of whole texts by a public byte-level BPE.

Overlapping chunk encoding. A text longer than a chunk is cut into chunks that
overlap; the chunks are pre-tokenised in parallel, by threads of the task that holds
the text. Pre-tokenising runs from left to right and looks back at nothing, so two
runs that share one boundary agree from there on: in every overlap the chunk's own
boundaries and those of the chunk before meet, and the text is cut where they first
do. The pieces are encoded on their own, in parallel too, and their ids joined. Where
no boundary of an overlap is shared (one word longer than the overlap) the rest of the
text stays one piece. Decoding joins the tokens' bytes. The table is read once and nothing
is shuffled for it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.runtime import spread

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS = 1 << 12, 1 << 8
THREADS = 2
#: Fixed value: the pattern that cuts a text into pre-tokens for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str, start: int = 0) -> list[int]:
    """Ends of the pre-tokens of text[start:]. Other threads go on while the pattern runs."""
    return [m.end() for m in _pattern().finditer(text, start, concurrent=True)]


def cut_points(chunk: str, head: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk in its first and its last `head` characters, from which pieces may start.

    Only those behind a character that is no white space: there the text before is cut
    into the same pre-tokens whether or not more follows. The last pre-token of a chunk
    that is not the text's last may go on beyond it and counts as none.
    """
    ends = boundaries(chunk)
    ends = ends if last else ends[:-1]
    safe = [e for e in ends if not chunk[e - 1].isspace()]
    return [e for e in safe if e <= head], [e for e in safe if e >= len(chunk) - head]


def pieces(text: str, chunk: int, overlap: int, pool) -> list[str]:
    """The text in pieces whose pre-tokens are those of the whole."""
    if len(text) <= chunk:
        return [text]
    starts = range(0, len(text) - overlap, chunk - overlap)
    marks = list(pool.map(lambda f: cut_points(text[f : f + chunk], overlap, f + chunk >= len(text)), starts))
    cuts = [0]
    for f, before, (head, _), (_, tail) in zip(starts[1:], starts, marks[1:], marks):
        shared = {f + e for e in head} & {before + e for e in tail}
        if not shared:
            break
        cuts.append(min(shared))
    return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)])]


def encode_texts(docs: DataFrame, *, key: str, text: str, vocabulary: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of docs, ids of the whole text without special tokens.

    A null text and an empty text have no tokens: their ids are an empty list. The
    strings of special tokens are ordinary text. Rows with the same key, and null
    keys, keep their own rows. Texts of up to `chunk` characters are one chunk.
    """
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    path = vocabulary or vocabulary_path()
    base = spread(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")))
    kind = dict(docs.select(key).dtypes)[key]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        with ThreadPoolExecutor(THREADS) as pool:
            for b in batches:
                out = []
                for t in b["_t"]:
                    parts = pieces(t, chunk, overlap, pool) if isinstance(t, str) else []
                    ids = [enc.encode_ordinary(parts[0])] if len(parts) == 1 else pool.map(enc.encode_ordinary, parts)
                    out.append([i for p in ids for i in p])
                yield pd.DataFrame({key: b["_k"], "ids": out})

    return base.mapInPandas(encode, f"`{key}` {kind}, ids array<int>")


def decode_ids(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of ids: the tokens' bytes, joined."""
    return encoder(vocabulary or vocabulary_path()).decode_bytes(list(ids)).decode("utf-8")

"""Token ids of whole texts, chunk by overlapping chunk.

A byte-level BPE pre-tokenizer never lets one piece hold a visible character that is
followed by white space: of its alternatives only ` ?x+` has a space, and has it first,
and the white-space runs hold nothing else. So each place where white space follows a
visible character is a token boundary, whatever stands before or after it. These are the
stable boundaries at which chunks may be spliced.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256

#: A visible ASCII character or a letter before plain white space. Characters on which regular-expression engines differ (1C-1F, format characters) never stand beside a stable boundary.
_STABLE = re.compile(r"(?:[!-~]|[^\W\d_])(?=[ \n\t\r])")


def is_plain(settings: dict) -> bool:
    """Whether a `.json` vocabulary is plain byte-level BPE: bytes pre-tokenized by the library's own expression, nothing normalised, dropped or
    prefixed, merges ranked as the ids of what they make, special strings taken literally and free of white space. The stable boundaries
    and the twin hold for these alone.
    """
    model, split = settings["model"], settings.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or settings.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t[k] for t in settings.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    if any(c.isspace() for t in settings.get("added_tokens", []) for c in t["content"]):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in made and all(x < y for x, y in zip(made, made[1:]))


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Ids of a text as the library gives them for a `.json` vocabulary, with special strings read as its default does.

    Where the vocabulary is plain and a `.tiktoken` file of the same name lies beside it and has the very same
    tokens, that library does the work: it gives the same ids in a quarter of the time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.plain = is_plain(json.load(file))
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.fast = self._twin(path.removesuffix(".json") + ".tiktoken") if self.plain else None
        sizes = [0] * (max(self.library.get_vocab().values(), default=-1) + 1)
        for token, i in self.library.get_vocab().items():
            sizes[i] = len(token.encode()) if token in self.specials else len(token)  # one character of a byte-level token stands for one byte
        self.sizes = np.array(sizes, np.int64)

    def _twin(self, path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        shown = byte_characters()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = {token: i for token, i in self.library.get_vocab().items() if token not in self.specials}
        if own != {"".join(map(shown.__getitem__, token)): rank for token, rank in ranks.items()}:
            return None
        return tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)

    def ids_with_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the byte offset at which each ends."""
        ids = self.ids(text)
        return ids, np.cumsum(self.sizes[ids])


def _boundary(ends: np.ndarray, at: int) -> int | None:
    """How many tokens end at or before byte `at`, if a token ends there."""
    i = int(np.searchsorted(ends, at))
    return i + 1 if i < len(ends) and ends[i] == at else None


def encode(encoder: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of a whole text.

    A text longer than `chunk` characters is encoded in chunks that overlap, with offsets.
    Neighbours are spliced at a place in their overlap that is proven stable and where a
    token ends in both. Where there is none (a long run without white space) the overlap is
    doubled; where it has grown to the whole earlier chunk, that chunk is doubled. Of a vocabulary for which no place is proven
    (see is_plain) a text is one chunk.
    """
    begin, end, width = 0, min(len(text), chunk), overlap
    if end == len(text) or not encoder.plain:
        return encoder.ids(text)
    ids, ends = encoder.ids_with_ends(text[begin:end])
    out: list[np.ndarray] = []
    while end < len(text):
        next_begin = end - width
        if next_begin <= begin:
            end, width = min(len(text), end + (end - begin)), overlap
            ids, ends = encoder.ids_with_ends(text[begin:end])
            continue
        next_end = min(len(text), max(next_begin + chunk, end + width))
        next_ids, next_ends = encoder.ids_with_ends(text[next_begin:next_end])
        skipped = len(text[begin:next_begin].encode())
        shared = text[next_begin:end]
        for place in _STABLE.finditer(shared):
            at = len(shared[: place.end()].encode())
            keep, drop = _boundary(ends, skipped + at), _boundary(next_ends, at)
            if keep is not None and drop is not None:
                break
        else:
            width *= 2
            continue
        out.append(ids[:keep])
        begin, end, width = next_begin + place.end(), next_end, overlap
        ids, ends = next_ids[drop:], next_ends[drop:] - at
    return np.concatenate([*out, ids])


@lru_cache(maxsize=2)
def encoder_at(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _sentencepiece_at(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_count(text: Column, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Tokens of a whole text (null: none), as the vocabulary's own library counts them.

    A `.json` file: byte-level BPE, by overlapping chunks. A `.model` file: the library on the whole text.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        if path.endswith(".model"):
            model = _sentencepiece_at(path)
            return pd.Series([len(model.encode(t, num_threads=1)) for t in texts], dtype="int64")
        encoder = encoder_at(path)
        return pd.Series([len(encode(encoder, t, chunk, overlap)) for t in texts], dtype="int64")

    return count.asNondeterministic()(text)  # so that it's computed once where it is used twice


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat are counted each; an
    empty table gives an empty one; other columns are not read. Special strings inside a text
    are read as the library does by default.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

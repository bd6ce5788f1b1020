"""Token ids of whole texts for a vocabulary of words, word by word.

Where no token can hold white space and white space is dropped, a text's ids are those of
its runs without white space, one after the other: NFC never joins a space with what
stands beside it, lower case goes character by character, and no alternative of the split
matches white space. So the ids of a run are looked up in a bounded cache. A run of plain
characters (visible ASCII, Latin-1 letters) is NFC already, and is cut into words by
an expression that means the same for it as the vocabulary's; only words that the
cache lacks go to the library's model. Any other run goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

from .tokens import byte_characters

#: Runs and words that a worker remembers at most; a full cache is emptied.
MOST_RUNS, MOST_WORDS = 1 << 19, 1 << 18
#: Longer runs aren't remembered.
LONGEST_RUN = 64

# The split and the normalizers of the vocabularies for which runs are taken one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

_PLAIN_TEXT = re.compile("[ \n\t\r!-~À-ÖØ-öø-ÿ]*")
_PLAIN_RUN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
#: SPLIT for plain runs in lower case.
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\[-`{-~]+")


def goes_by_runs(settings: dict) -> bool:
    """Whether a `.json` vocabulary's ids can be taken run by run: its settings are those that the module's proof is about."""
    model, steps = settings["model"], (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if (settings.get("normalizer") or {}).get("normalizers") != NORMALIZERS or [s.get("type") for s in steps] != ["Split", "ByteLevel"]:
        return False
    split, byte_level = steps
    if split.get("pattern") != {"Regex": SPLIT} or split.get("behavior") != "Removed" or not split.get("invert"):
        return False
    if byte_level.get("add_prefix_space") or byte_level.get("use_regex", True) or model.get("type") != "BPE" or model.get("dropout"):
        return False
    added = settings.get("added_tokens", [])
    return not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for t in added for c in t["content"])


class _Words(dict):
    """Ids of a word as little-endian unsigned 32-bit numbers, found by the library's model when it's first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model, self.shown = model, byte_characters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize("".join(map(self.shown.__getitem__, word.encode()))))
        if len(word) <= LONGEST_RUN:
            self[word] = found
        return found


class _Runs(dict):
    """Ids of a run without white space."""

    def __init__(self, library, specials: list[str]):
        super().__init__()
        self.library, self.specials, self.words = library, specials, _Words(library.model)

    def __missing__(self, run: str) -> bytes:
        if len(self) >= MOST_RUNS:
            self.clear()
        if _PLAIN_RUN.fullmatch(run) and not any(s in run for s in self.specials):
            found = b"".join(map(self.words.__getitem__, _WORDS.findall(run.lower())))
        else:
            found = packed(self.library, run)
        if len(run) <= LONGEST_RUN:
            self[run] = found
        return found


def packed(library, text: str) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


class WordEncoder:
    """Ids of texts as the library gives them for a `.json` vocabulary, without added special tokens; special strings in a text are read as its default does.

    A vocabulary that doesn't go by runs gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            by_runs = goes_by_runs(json.load(file))
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.runs = _Runs(self.library, self.specials) if by_runs else None

    def packed_ids(self, text: str) -> bytes:
        """All ids of a text, each a little-endian unsigned 32-bit number."""
        if self.runs is None:
            return packed(self.library, text)
        if _PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.specials):
            text = text.lower()  # fewer runs to remember
        return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(maxsize=2)
def word_encoder_at(path: str) -> WordEncoder:
    return WordEncoder(path)

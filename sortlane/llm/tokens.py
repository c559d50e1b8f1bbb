"""Encoding with a public byte-pair tokenizer file: the ids of the tokenizers library.

``Encoder`` reads the library's JSON file.  Ordinary text runs through tiktoken,
which merges bytes in the order of a rank table and is several times as fast; all
other text runs through the library itself.

Both merge the adjacent pair of the lowest rank first.  They differ in one thing:
the library merges listed pairs only, tiktoken any pair whose joined bytes are
in the table.  If each part of a merge is older than the merge, merging is local:
what happens between two places that no merge crosses depends on the bytes
between them alone.  So where joined bytes are a token, the library ends with that
token too, as long as the token's own bytes, taken alone, end with it.  Tokens for
which that fails can never result and are left out of the table.

Ordinary text holds letters, digits and punctuation that every Unicode version knows
alike, and no string of a special token; those get their own ids from the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: A word's last byte is a symbol of its own where the file has a suffix for word ends;
#: this byte behind the word stands for it.  Text that holds it is not ordinary.
END = "\0"
_ORDINARY = re.compile(r"[\t-\r -~¡-įı-ſ‐-‧€]*")
#: The pattern below steps back through a run of white space, up to a limit of its engine of a million;
#: a text with a run this long runs through the library, which has no such limit.
LONG_SPACE = 100_000
_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")
#: Fixed value: where a byte-level pre-tokeniser cuts.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: visible Latin-1
    characters for themselves, the next free code points from 256 for the others."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def _ends_as_itself(symbols: list[str], whole: str, ranks: dict[tuple[str, str], int]) -> bool:
    """Do the symbols of a token, merged by rank, end as the token?"""
    while len(symbols) > 1:
        rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == 1 << 60:
            return False
        symbols = symbols[:at] + [symbols[at] + symbols[at + 1]] + symbols[at + 2 :]
    return symbols == [whole]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        self.pieces = self.table = None
        self._ranked(spec)

    def _ranked(self, spec: dict) -> None:
        """Set up the fast way if the file is of a kind that it fits."""
        model, normalizer, cut = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        suffix, stages = model.get("end_of_word_suffix") or "", cut.get("pretokenizers") or [cut]
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or odd or spec.get("post_processor") or any(stages[-1].get(k) != v for k, v in _BYTE_LEVEL.items()):
            return
        alphabet, vocab = byte_alphabet(), model["vocab"]
        if suffix and len(stages) == 2 and stages[0].get("type") == "Split" and stages[0].get("invert") and stages[0].get("behavior") == "Removed" and _lowers(normalizer):
            import regex

            self.pieces = regex.compile(stages[0]["pattern"]["Regex"])
            pattern = f"[^{END}]+{END}"
        elif not suffix and len(stages) == 1 and not normalizer and stages[0].get("use_regex"):
            pattern = BYTE_LEVEL_PATTERN
        else:
            return
        import tiktoken

        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        ranks = {p: i for i, p in enumerate(pairs)}
        made = {a + b: i for (a, b), i in ranks.items()}
        if any(made.get(x, -1) >= i for (a, b), i in ranks.items() for x in (a, b)):
            return  # a merge is older than its parts
        to_bytes = lambda x: bytes(alphabet[c] for c in x.removesuffix(suffix)) + (END.encode() if suffix and x.endswith(suffix) else b"")
        symbols = lambda x: [*x] if not suffix or not x.endswith(suffix) else [*x[: -len(suffix) - 1], x[-len(suffix) - 1 :]]
        order = sorted(alphabet, key=alphabet.get) + [c + suffix for c in alphabet if suffix] + [x for x in made if _ends_as_itself(symbols(x), x, ranks)]
        tokens, seen = [], set()
        for x in order:
            raw = to_bytes(x)
            if raw not in seen and x in vocab and (not suffix or END.encode() not in raw[:-1]):
                seen.add(raw)
                tokens.append((raw, vocab[x]))
        if {bytes([b]) for b in range(256)} - seen:
            return
        self.table = np.array([i for _, i in tokens], "<u4")
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={raw: i for i, (raw, _) in enumerate(tokens)}, special_tokens={})

    def ordinary(self, text: str) -> bool:
        if self.table is None or END in text or (self.special and self.special.search(text)):
            return False
        if len(text) >= LONG_SPACE and _SPACE.search(text):
            return False
        return text.isascii() or _ORDINARY.fullmatch(text) is not None

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.ordinary(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self.pieces is not None:
            text = END.join(self.pieces.findall(text.lower()))
            if not text:
                return np.zeros(0, "<u4")
            text += END
        return self.table[np.array(self.fast.encode_ordinary(text), np.int64)]

    def encode_all(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The ids of each text, one after the other; null counts as empty."""
        for x in texts:
            yield self.encode(x.as_py() or "")


def _lowers(normalizer: dict | None) -> bool:
    """Does the normaliser only compose, fold white space and lower the case?"""
    kinds = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)

"""Ids of byte-level BPE vocabularies, for the operators that pack and store token ids."""

from __future__ import annotations

import json

import numpy as np

from .bpe import byte_letters


class ByteBpe:
    """A byte-level tokenizer file; ``ids`` equals its library's encode with add_special_tokens=False.

    Where each merge makes the id that follows the one before, the ids are merge ranks, and the faster
    rank-based encoder gives the same result; any other file is left to its own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        if plain and spec["normalizer"] is None and not model.get("ignore_merges") and made == list(range(256, 256 + len(made))):
            import tiktoken

            byte = {c: b for b, c in enumerate(byte_letters())}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            self.ids = lambda text: encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self.ids = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]

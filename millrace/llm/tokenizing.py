"""Whole texts to token ids, inside Spark tasks."""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CHUNK, KEPT, chunks

#: How a pattern begins that takes a run of letters as one word, unless a quote stands before it.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|"
#: Trailing punctuation that a word-level tokenizer always splits from a letter or digit before it.
TAIL = b".,!?%&*#$:;"


class Encoder:
    """Token ids of a ``tokenizers`` file, without special tokens of its own, as packed integers.

    Tokenizers that drop white space and mark ends of words encode each word by itself; words are
    then encoded once and remembered, up to ``remember`` of them; those not used for long go first. All others encode whole texts.
    """

    def __init__(self, path: str, remember: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.size, self.remember = size, remember
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        suffix = config["model"].get("end_of_word_suffix")
        splitters = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = bool(suffix) and any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in splitters)
        if self.by_word:
            self.ends = np.zeros(size, bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
            self.letters = self._for_letters(path, config, splitters)
            self.words: dict[bytes, bytes] = {b"": b""}
            self.older: dict[bytes, bytes] = {}

    def _for_letters(self, path: str, config: dict, splitters: list[dict]):
        """The same model for words of Latin-1 letters in lower case, which need neither normalising nor a pattern; None if that isn't sure."""
        from tokenizers import Tokenizer, pre_tokenizers

        steps = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or config["normalizer"]["normalizers"][1]["pattern"] != {"Regex": "\\s+"}:
            return None
        if [s["type"] for s in splitters] != ["Split", "ByteLevel"] or not splitters[0]["pattern"].get("Regex", "").startswith(LETTERS):
            return None
        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, packed as ``kind``."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        out: list[bytes] = []
        for a, b in chunks(texts, 4 * CHUNK):
            out += self._by_word(texts[a:b])
        return out

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = split.flatten().dictionary_encode()
        found = coded.dictionary.view(pa.binary()).to_pylist()
        of_word = list(map(self.words.get, found))
        if None in of_word:
            missing = [w for w, x in zip(found, of_word) if x is None]
            if len(self.words) + len(missing) > self.remember // 2:
                self.older, self.words = self.words, {b"": b""}  # no word before and after white space at the ends
                missing = [w for w in found if w]
            before = list(map(self.older.get, missing))
            self.words.update((w, x) for w, x in zip(missing, before) if x is not None)
            self._learn([w for w, x in zip(missing, before) if x is None])
            of_word = list(map(self.words.__getitem__, found))
        # Arrow puts the ids of the words one after the other; its offsets cut them into texts.
        ids = pa.array(of_word, pa.binary()).take(coded.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy(), dtype=np.int64))
        raw = memoryview(ids.buffers()[2]) if ends[-1] else b""
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [bytes(raw[x:y]) for x, y in zip(cuts, cuts[1:])]

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def _ends_in_letter(self, core: bytes) -> bool:
        """Whether a letter or number is last as the tokenizer reads the word: some letters become one with a mark."""
        text = core.decode("utf-8", "replace")
        if text[-1].isalnum() and self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return unicodedata.category(text[-1:] or " ")[0] in "LN"

    def _learn(self, missing: list[bytes]) -> None:
        words, parts, plain, latin, odd = self.words, {}, set(), set(), set()
        if self.letters:
            latin.update(filter(bytes.isalpha, missing))  # A-Z and a-z alone
        for word in missing:
            if word in latin:
                continue
            core = word.rstrip(TAIL)
            if len(core) < len(word) and core and (core[-1:].isalnum() or self._ends_in_letter(core)):
                parts[word] = core
                tail = word[len(core) :]
                if tail not in words:
                    odd.add(tail)
            else:
                core = word
            if core not in words:
                text = core.decode("utf-8", "replace")
                (odd if not text.isalpha() else latin if self.letters and max(text) < "\u0100" else plain).add(core)
        self._learn_letters(list(plain - odd), self.tokenizer)
        self._learn_letters(list(latin - odd), self.letters)
        for word in odd:
            words[word] = self._whole(word)
        for word, core in parts.items():
            words[word] = words[core] + words[word[len(core) :]]

    def _learn_letters(self, cores: list[bytes], tokenizer) -> None:
        """Many words in one call; the marks at their ends cut the ids apart again."""
        for i in range(0, len(cores), 512):
            some = cores[i : i + 512]
            text = b" ".join(some).decode("utf-8", "replace")
            joined = tokenizer.encode_batch_fast([text.lower() if tokenizer is self.letters else text], add_special_tokens=False)[0].ids
            ids = np.array(joined, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or (len(ids) and cuts[-1] != len(ids)):  # a letter that becomes more than letters
                for word in some:
                    self.words[word] = self._whole(word)
                continue
            packed, width, start = ids.tobytes(), self.kind.itemsize, 0
            for word, cut in zip(some, cuts.tolist()):
                self.words[word] = packed[start * width : cut * width]
                start = cut


@lru_cache(maxsize=2)
def encoder(path: str, remember: int = 400_000) -> Encoder:
    """One for each Python worker and file; tasks that follow find its words known."""
    return Encoder(path, remember)


KEPT.append(encoder)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

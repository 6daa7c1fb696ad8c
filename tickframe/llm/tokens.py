"""Ids of the public word-end BPE vocabulary, word by word with a bounded memory of words seen."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: Words remembered for good in a worker process, and words remembered for a while beside them; then the same of pieces, which are
#: looked up for new words only. What is forgotten is worked out again; no result changes.
KEPT, PASSING = 450_000, 200_000
KEPT_PIECES, PASSING_PIECES = 110_000, 50_000
#: One word a line: a plain one of Latin letters, which the vocabulary only lower-cases, and ASCII marks after them, a piece
#: of their own; or any other.
_LINE = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)|(.*))$", re.M)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Keeps its first ``kept`` entries; later ones are dropped together when there are ``passing`` of them."""

    def __init__(self, kept: int, passing: int) -> None:
        self.of: dict = {}
        self._late: list = []
        self._kept, self._passing = kept, passing

    def put(self, keys: list, values: list[bytes]) -> None:
        if len(self.of) >= self._kept:
            self._late += keys
        self.of.update(zip(keys, values))

    def trim(self) -> None:
        if len(self._late) > self._passing:
            for key in self._late:
                self.of.pop(key, None)
            self._late.clear()


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers. White space always parts this vocabulary's tokens, so the ids of
    a text are those of its words in a row; only pieces of words not seen before reach the tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # for pieces that are lower-cased and parted already: the same merges without the work before them
        self._merges = Tokenizer.from_file(path)
        self._merges.normalizer = normalizers.Sequence([])
        self._merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._words, self._pieces = Memory(KEPT, PASSING), Memory(KEPT_PIECES, PASSING_PIECES)
        size = self._tokenizer.get_vocab_size()
        #: whether an id ends a sentence, and whether it ends a piece
        self.ends_sentence, self._ends_piece = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._ends_piece[i] = token.endswith("</w>")
            self.ends_sentence[i] = token.endswith("</w>") and token[:-4].rstrip("\"')]»”’")[-1:] in (".", "!", "?")

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 2000):
            part = pieces[at:at + 2000]
            ids = np.array(self._merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw = ids.tobytes()
            ends = [0] + (4 * (np.flatnonzero(self._ends_piece[ids]) + 1)).tolist()
            if len(ends) != len(part) + 1:
                raise ValueError("a piece of the vocabulary does not end where it should")
            self._pieces.put(part, [raw[i:j] for i, j in zip(ends, ends[1:])])

    def _learn_others(self, words: list[bytes]) -> None:
        texts = [w.decode(errors="replace") for w in words]
        encoded = self._tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.array([o[0] for o in encoded.offsets], np.int64)
        cuts = np.searchsorted(starts, ends[:-1])
        self._words.put(words, [part.tobytes() for part in np.split(ids, cuts)])

    def _learn(self, words: list[bytes]) -> None:
        lines = _LINE.findall(b"\n".join(words).decode(errors="replace").lower())
        known = self._pieces.of
        self._learn_pieces(list({p for line in lines for p in line[:2] if p and p not in known}))
        plain = [word for word, line in zip(words, lines) if line[0]]
        self._words.put(plain, [known[a] + known[b] if b else known[a] for a, b, _ in lines if a])
        others = [word for word, line in zip(words, lines) if not line[0]]
        for at in range(0, len(others), 2000):
            self._learn_others(others[at:at + 2000])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        split = [t.split() if t else [] for t in texts]
        self._words.trim()
        self._pieces.trim()
        known = self._words.of
        new = set().union(*split).difference(known)
        if new:
            self._learn(list(new))
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@cache
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that tasks share what has been learned."""
    return WordIds(path)

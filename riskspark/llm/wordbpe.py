"""Encoding whole texts with the tokenizers library inside Spark tasks.

A tokenizer that drops white space encodes each word apart from its neighbours. Its words are looked up in a memo and
only new ones go through the library, many in one call; the ids are those of the whole text. Other tokenizers get whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

MEMO_WORDS = 600_000
MEMO_LETTERS = 48
#: Marks after a word that are looked up apart from it, up to so many.
TAIL_MARKS = 4


def tokenizer_file(name: str) -> str:
    """The text of a tokenizer file: `name` is a path, or a file of the public tokenizers that are installed."""
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """encode() gives ids as little-endian unsigned 32-bit integers. The memo is cleared when it holds MEMO_WORDS words.

    New words that are all Latin letters, with a few marks after them or none, go to the library's model directly, as lower case in byte letters; others through all
    of it. What the tokenizer does with white space, marks and letters is tried out first, and where it differs texts go through it whole.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.four = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.memo: dict[str, bytes] = {}
        probe = ["ab", "cd", "ef", ".", ",."]
        parts = [self._ids(x) for x in probe]
        self.by_word = self._ids("ab cd\nef . ,.  ") == b"".join(parts)
        self.by_tail = self._ids("ab,.") == parts[0] + parts[4] and self._ids("ab.cd") == parts[0] + parts[3] + parts[1]
        self.marks = "".join(self._own_marks()) if self.by_tail else ""
        self.tails: dict[str, bytes] = {}
        self.by_model = all(self._of_model(w) == self._ids(w) for w in ("the", "Reading", "Éléphantö", "straßenñ", "QuizzicallY", "xqzj"))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _own_marks(self) -> list[str]:
        """The ASCII marks that stand apart from letters before them, whichever mark follows."""
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
        letters, runs = self._ids("ab"), [c + d for c in marks for d in ("", *marks)]
        plain = {c: True for c in marks}
        for run, whole, alone in zip(runs, *(self.tokenizer.encode_batch([x + r for r in runs], add_special_tokens=False) for x in ("ab", ""))):
            plain[run[0]] &= np.array(whole.ids, "<u4").tobytes() == letters + np.array(alone.ids, "<u4").tobytes()
        return [c for c in marks if plain[c]]

    def _of_model(self, word: str) -> bytes:
        low = word.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(low)])

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = []
        for k in range(0, len(texts), 512):
            words = [t.replace("\n", " ").split(" ") for t in texts[k : k + 512]]
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            memo = self.memo
            new = set().union(*words).difference(memo)
            self._learn(new)
            out += [b"".join(map(memo.__getitem__, ws)) for ws in words]
            for w in new:
                if len(w) > MEMO_LETTERS:
                    del memo[w]
        return out

    def _learn(self, words: Iterable[str]) -> None:
        memo, tails, marks, by_model, odd = self.memo, self.tails, self.marks, self.by_model, []
        for w in words:
            body = w.rstrip(marks) if marks else w
            if not by_model or len(w) > len(body) + TAIL_MARKS or not body.isalpha() or not (body.isascii() or max(body) < "\u0130"):
                odd.append(w)
            elif len(w) == len(body):
                if w not in memo:
                    memo[w] = self._of_model(w)
            else:
                ids, tail = memo.get(body), w[len(body) :]
                if ids is None:
                    ids = memo[body] = self._of_model(body)
                if tail not in tails:
                    if len(tails) > MEMO_WORDS // 10:
                        tails.clear()
                    tails[tail] = self._ids(tail)
                memo[w] = ids + tails[tail]
        for w, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
            memo[w] = np.array(e.ids, "<u4").tobytes()


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One for each worker process."""
    if hash(spec) not in _encoders:
        _encoders[hash(spec)] = Encoder(spec)
    return _encoders[hash(spec)]

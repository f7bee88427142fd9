"""Whole-text encoding with the tokenizers library, one memo per Python worker.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each one by itself. A text can
therefore be cut at every single space between two other characters without changing its ids, and the
ids of such a word can be kept: a corpus repeats its words far more often than it brings new ones.
A single line feed between such characters is a pre-token of its own, so texts are cut before it as well.
Words not seen before are cut into pre-tokens, and the distinct ones that are new too are encoded by the
library in one call. Tokenizers of any other kind encode whole texts directly.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

from sightline.llm import worker

#: Fixed value: how byte-level BPE tokenizers of this family cut a text into pre-tokens.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_MARKS = frozenset(".,;:!?|")
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]  # Unicode has none beyond
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def cuts_anywhere(text: str) -> bool:
    """Whether every space stands between two characters that are no white space."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RARE_SPACES))


def cut_lines(text: str) -> str:
    """The text with a space before each line feed, if all stand alone: its words then start with what stood before them."""
    return text if "\n\n" in text else text.replace("\n", " \n")


def byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def pre_tokens(word: str) -> list[str]:
    """The pre-tokens of a word; letters with a mark after them, which most words are, need no pattern."""
    if word[:1] == "\n" and word[1:2].strip():
        return ["\n", *pre_tokens(word[1:])]
    body = word[1:] if word[:1] == " " else word
    if body.isalpha():
        return [word]
    if body[-1:] in _MARKS and body[:-1].isalpha():
        return [word[:-1], word[-1]]
    return PRE_TOKENS.findall(word)


def _nones(x: list):
    at = -1
    while True:
        try:
            at = x.index(None, at + 1)
        except ValueError:
            return
        yield at


class Encoder:
    """Ids of texts as arrays of ``dtype``; the memo keeps the first ``memo_words`` words it meets.

    Distinct words are looked up once per call, however many texts it has; ids are written out ``run_words`` words at a time.
    """

    def __init__(self, path: str, memo_words: int = 1_600_000, run_words: int = 1_000_000):
        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo_words, self.run_words = memo_words, run_words
        self.memo: dict[str, bytes] = {}  # by the word without the space before it, or with a line feed instead
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        pre = self.whole.pre_tokenizer
        self.by_word = isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.whole.normalizer is None
        if self.by_word:
            letters = byte_letters()
            self.letters = [(chr(b), chr(c)) for b, c in letters.items() if b != c and b != 10]
            self.pieces = Tokenizer.from_file(path)
            self.pieces.pre_tokenizer = CharDelimiterSplit("\n")  # no byte has this letter
            vocab = self.whole.get_vocab()
            self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            self.lengths[list(vocab.values())] = [len(t) for t in vocab]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that stand alone or after a cut, through their distinct pre-tokens."""
        cut = [pre_tokens(w) for w in words]
        ids = {p: self.memo.get(p[1:]) if p[0] == " " else None for p in set(chain.from_iterable(cut))}
        lines = [p for p in ids if "\n" in p]  # the memo has a word after a line feed where these have a space
        ids.update(zip(lines, self._plain(lines), strict=True))
        new = [p for p, x in ids.items() if x is None]
        if new:
            raw = list(map(str.encode, new))
            mapped = b"\n".join(raw).decode("latin-1")
            for b, letter in self.letters:
                mapped = mapped.replace(b, letter)
            flat = np.asarray(self.pieces.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.lengths[flat]), np.cumsum(list(map(len, raw)))) + 1
            ends = (ends * self.dtype.itemsize).tolist()
            flat = flat.tobytes()
            ids.update(zip(new, [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            if len(self.memo) < self.memo_words:
                self.memo.update((p[1:], ids[p]) for p in new if p[0] == " " and len(p) > 1)
        return [ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c]) for c in cut]

    def _ids_after_space(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words with a space before them, from the memo or learned now."""
        ids = list(map(self.memo.get, words))
        gaps = list(_nones(ids))
        for a in range(0, len(gaps), 20_000):
            some = gaps[a : a + 20_000]
            fresh = self._learn([w if w[:1] == "\n" else " " + w for w in map(words.__getitem__, some)])
            for i, x in zip(some, fresh, strict=True):
                ids[i] = x
            if len(self.memo) < self.memo_words:
                self.memo.update(zip([words[i] for i in some], fresh, strict=True))
        return ids

    def _by_distinct_words(self, texts: list[str]) -> list[bytes]:
        """Texts that any single space may cut: words are found and told apart in bulk, and only distinct ones looked up."""
        parts = [cut_lines(t).partition(" ") for t in texts]
        firsts = self._learn([first for first, _, _ in parts])
        rests = pa.array([rest if space else None for _, space, rest in parts], pa.large_string())
        del parts  # texts are large: each form goes when the next one is there
        split = pc.split_pattern(rests, " ")
        del rests
        last = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(), dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del coded
        known = self._ids_after_space(words)
        del words
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(known), self.dtype)
        del known
        out: list[bytes] = []
        for some in np.split(last, np.flatnonzero(np.diff(last // self.run_words)) + 1):  # texts whose ids are written out at a time
            before = int(last[len(out) - 1]) if out else 0
            run = codes[before : int(some[-1])]
            n = size[run]
            ends = np.cumsum(n)
            ids = flat[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start[run] - (ends - n), n)]
            upto = np.concatenate([[0], ends])[some - before].tolist()
            out += [f + ids[a:b].tobytes() for f, a, b in zip(firsts[len(out) : len(out) + len(some)], [0, *upto[:-1]], upto, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of a little-endian array."""
        if not self.by_word:
            return self._plain(texts)
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        skip = set(whole)
        odd = [i for i, t in enumerate(texts) if i not in skip and not cuts_anywhere(t)]
        skip.update(odd)
        plain = [i for i, t in enumerate(texts) if t and i not in skip]
        for places, how in ((whole, self._plain), (odd, self._by_words), (plain, self._by_distinct_words)):
            for i, ids in zip(places, how([texts[i] for i in places]) if places else (), strict=True):
                out[i] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) for t in texts]
        firsts = self._learn([w[0] for w in cut])
        distinct = list({x for w in cut for x in w[1:]})
        ids = dict(zip(distinct, self._ids_after_space(distinct), strict=True))
        return [f + b"".join([ids[x] for x in w[1:]]) for f, w in zip(firsts, cut, strict=True)]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; later tasks of the worker find its memo filled, unless other work let go of it."""
    if path not in worker.KEPT:
        worker.KEPT[path] = Encoder(path)
    return worker.KEPT[path]


def batches(texts: list[str], letters: int = 6_000_000):
    """Slices of a list of texts with about so many letters each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > letters:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))

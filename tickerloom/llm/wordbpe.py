"""Token ids of whole texts by a public tokenizer file, at the cost of its new words only.

The tokenizer cuts at white space before anything else, its normaliser neither joins nor
reorders characters across a blank, and its special strings hold none.  So the ids of a text
are those of its blank-separated words one after another, and a word met before need not be
encoded again.  Texts are cut at blanks and line feeds alone; other white space stays inside
a word, where the tokenizer itself deals with it.  The tokenizer lower-cases, so A-Z is lower-cased
first, but for texts with combining marks, which compose with small letters only, or with special strings.
A table numbers the words, and the ids of all its words lie in one array, from which those of the texts are taken by number.
The tables are bounded; words met again outlive the others.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice, repeat

import numpy as np

VOCABULARY = "word_bpe_49k.json"
MOST_WORDS = 200_000
MOST_IDS = 16 * MOST_WORDS
LONG_WORD = 64
TOGETHER = 1 << 20  # words whose ids are taken at once
# Small letters of the first two Unicode blocks: neither normalising nor cutting changes a word of these.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# Something that ends in a letter, and ASCII signs after it, which are a stretch of their own for the tokenizer; an apostrophe may not be, and '>' may end a special string.
ENDED = re.compile(rb"(.*(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]))([!-&(-/:-=?@[-`{-~]+)", re.S)
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str | None = None) -> "Encoder":
    """The encoder of this process."""
    import public_tokenizers

    key = (path or public_tokenizers.path(VOCABULARY), os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(key[0])
    return _ENCODERS[key]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str())
        cut = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "pre_tokenizer": cut}))
        suffix = bare["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.words, self.older = Words(), Words()

    def whole(self, text: str) -> np.ndarray:
        """The ids as the library gives them for the text in one piece."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Begin and end of every token, in characters of the text."""
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [tuple(np.array(e.offsets, np.int64).reshape(-1, 2).T) for e in got]

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        cut = [folded(t).replace(b"\n", b" ").split(b" ") for t in texts]
        ends = np.cumsum([0, *map(len, cut)])
        if len(self.words.flat) > MOST_IDS:
            self.words, self.older = Words(), Words()
        elif len(self.words.number) > MOST_WORDS:
            self.words, self.older = Words(), self.words
        words = self.words
        known = len(words.number)
        numbers = np.fromiter(map(words.number.__getitem__, chain.from_iterable(cut)), np.int32, int(ends[-1]))
        del cut
        if len(words.number) > known:
            self._add(list(islice(words.number, known, None)), known)
        raw, at = words.bytes_of(numbers, ends)
        for word in [w for w in islice(words.number, known, None) if len(w) > LONG_WORD]:
            del words.number[word]
        return [raw[a:z] for a, z in zip(at, at[1:])]

    def _add(self, new: list[bytes], known: int) -> None:
        """The ids of new words: those of the older table, those of a stem and what ends it, or those that the library gives."""
        words, older = self.words, self.older
        number, first = words.number, len(words.at) - 1
        plain, others, ended, parts = [], [], [], []
        there, before = older.places(new), 0
        while before < len(new):  # stems may be new, too
            for i in (np.flatnonzero(there[before:] < 0) + before).tolist():
                word = new[i]
                if PLAIN.fullmatch(word):
                    plain.append(i)
                elif end := ENDED.fullmatch(word):
                    ended.append(i)
                    parts.append((number[end[1]], number[end[2]]))
                else:
                    others.append(i)
            before = len(new)
            new += islice(number, known + before, None)
            there = np.concatenate([there, older.places(new[before:])])
        met = np.flatnonzero(there >= 0)
        begin, size = np.zeros((len(new), 2), np.int64), np.zeros((len(new), 2), np.int64)
        begin[met, 0], size[met, 0] = len(words.flat) + older.at[there[met]], older.at[there[met] + 1] - older.at[there[met]]
        pool, base = [words.flat, older.flat], len(words.flat) + len(older.flat)
        for here, ids, at in self._encode(new, plain, others):
            begin[here, 0], size[here, 0] = base + at[:-1], np.diff(at)
            pool.append(ids)
            base += len(ids)
        if ended:
            parts = np.array(parts)
            begin[ended] = np.concatenate([words.at[:-1], begin[:, 0]])[parts]
            size[ended] = np.concatenate([np.diff(words.at), size[:, 0]])[parts]
        words.flat = np.concatenate([words.flat, taken(np.concatenate(pool), begin.ravel(), size.ravel())])
        words.at = np.concatenate([words.at, words.at[-1] + np.cumsum(size.sum(1))])

    def _encode(self, words: list[bytes], plain: list[int], others: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Encode many words as few texts: places of words, their ids one after another, and where each word's begin.

        Plain words end where a token ends a word, the others are told apart by the offsets.
        """
        for part in (plain[i:i + 20_000] for i in range(0, len(plain), 20_000)):
            texts = [b" ".join([words[k] for k in part[i:i + 500]]).decode() for i in range(0, len(part), 500)]
            got = self.bare.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in got), "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part) and at[-1] == len(ids):
                yield part, ids, np.append(0, at)
            else:
                others = others + part
        for part in (others[i:i + 500] for i in range(0, len(others), 500)):
            text = b" ".join([words[k] for k in part]).decode()
            got = self.tokenizer.encode(text, add_special_tokens=False)
            begins = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
            ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
            yield part, np.array(got.ids, "<u4"), np.append(0, np.searchsorted(begins, ends))


class Words:
    """Numbered words; the ids of word ``n`` are ``flat[at[n]:at[n + 1]]``.  A word that is looked up gets a number; its ids must be added then."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.at = np.zeros(0, "<u4"), np.zeros(2, np.int64)
        self.number[b""]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for those that have none."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def bytes_of(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids of all words, and in bytes where those up to each of ``ends`` end."""
        sizes = np.diff(self.at)
        raw, before, place = [], 0, np.zeros(len(ends), np.int64)
        for k in range(0, len(numbers), TOGETHER):
            some = numbers[k:k + TOGETHER]
            size = sizes[some]
            upto = before + np.append(0, np.cumsum(size))
            mine = slice(*np.searchsorted(ends, [k, k + len(some) + 1]))
            place[mine] = upto[ends[mine] - k]
            raw.append(taken(self.flat, self.at[some], size).tobytes())
            before = upto[-1]
        return b"".join(raw) if len(raw) != 1 else raw[0], (4 * place).tolist()


def taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def folded(text: str) -> bytes:
    raw = text.encode()
    return raw if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.lower()

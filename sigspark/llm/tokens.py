"""Token ids of whole texts by a vocabulary file of the tokenizers library, one look-up per distinct word.

Both kinds of vocabulary used here never join characters across a blank that follows a non-blank character: their
pre-tokenizers start a new piece there. So texts are cut at such blanks by Arrow, the words of about two million characters are
dictionary-encoded, and only words that the worker's store lacks go to the library, many of them in one call. The ids of the
texts are then gathered from the store with NumPy offsets.

A text in which a blank follows other white space, or that contains the start of a special token, is not looked up: it goes
to the library in sections that end before a single blank between two other characters. A long text is cut into sections as
well, so memory is bounded by a section and the store.

The vocabulary with word ends drops all white space, so its texts are cut at any of it. It also lower-cases, and splits at
places that a pattern fixes: a word of ASCII and Western European letters, which normalisation leaves alone, is cut there and
its pieces, fewer than words, are looked up in a store of their own; a piece ends with the one id whose token has the word end.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, characters of words and ids of a store; a full one is kept until the next one is full. Some 150 MB a worker process.
WORDS, CHARS, IDS = 250_000, 8_000_000, 2_000_000
#: First words of texts that are kept.
HEADS = 50_000
#: Characters of the texts that are looked up together, and of a section that the library encodes whole.
SLICE, SECTION = 1 << 21, 1 << 16
#: Words that one call of the library encodes as one text.
ROW = 256
#: Where the vocabulary with word ends splits lower-cased words of these characters, and its mark of a word end.
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+| ")
WORD_END = "</w>"
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


class Store:
    """Ids of words, appended to one array; ``old`` is the full store before it, from which words that are used again come."""

    def __init__(self, old: Store | None = None) -> None:
        self.old = old
        if old is not None:
            old.old = None
        self.index: dict[str, int] = {}
        self.chars = self.used = 0
        self.flat = np.empty(1 << 16, dtype="<u4")
        self.start = np.empty(1 << 12, dtype=np.int64)
        self.length = np.empty(1 << 12, dtype=np.int64)

    def full(self) -> bool:
        return len(self.index) > WORDS or self.chars > CHARS or self.used > IDS

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, total = len(self.index), self.used + len(ids)
        last = first + len(words)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(total, dtype="<u4")])
        if last > len(self.start):
            more = np.empty(last, dtype=np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.flat[self.used : total] = ids
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.length[first:last] = sizes
        self.index.update(zip(words, range(first, last)))
        self.chars += sum(map(len, words))
        self.used = total

    def places(self, words: np.ndarray, learn: Callable[[list[str]], None]) -> np.ndarray:
        """Where distinct ``words`` are; ``learn`` has to add those that are missing."""
        found = np.array(list(map(self.index.get, words, repeat(-1))), dtype=np.int64)
        missing = words[found < 0]
        if not len(missing):
            return found
        new = missing
        if self.old is not None:
            there = np.array(list(map(self.old.index.get, missing, repeat(-1))), dtype=np.int64)
            known, new = missing[there >= 0], missing[there < 0]
            ids, stops = self.old.gather(there[there >= 0])
            self.add(known.tolist(), ids, np.diff(stops))
        if len(new):
            learn(new.tolist())
        found[found < 0] = list(map(self.index.__getitem__, missing))
        return found

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places and where each word's ids stop, with a 0 before."""
        sizes = self.length[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.start[at] - stops[:-1], sizes) + np.arange(stops[-1])], stops


class Encoder:
    """``blanks`` says whether the vocabulary encodes a blank together with the word after it."""

    def __init__(self, path: str, blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # for pieces that normalisation leaves alone
        self.normal = Tokenizer.from_file(path)
        if self.normal.normalizer is not None:
            self.normal.normalizer = None
        self.blanks = blanks
        names = self.library.get_vocab()
        self.starts, self.ends = (np.zeros(max(names.values()) + 1, dtype=bool) for _ in range(2))
        if blanks:
            blank = self.library.id_to_token(int(self._alone(" ")[0]))
            self.starts[[i for name, i in names.items() if name.startswith(blank)]] = True
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        # the last four separators are blanks to Python only
        risky = specials + [r"\s " if blanks else r"[\x1c-\x1f]"]
        self.whole = re.compile("|".join(risky))
        self.words, self.pieces = Store(), Store()
        self.heads: dict[str, np.ndarray] = {}

    def _batch(self, texts: list[str], normal: bool = False) -> list[np.ndarray]:
        library = self.normal if normal else self.library
        return [np.array(e.ids, dtype="<u4") for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, text: str) -> np.ndarray:
        return self._batch([text])[0]

    def _head(self, word: str) -> np.ndarray:
        """Ids of the first word of a text; short ones are kept."""
        found = self.heads.get(word)
        if found is None:
            found = self._alone(word)
            if len(self.heads) >= HEADS:
                self.heads.clear()
            if len(word) <= 32:
                self.heads[word] = found
        return found

    def _rows(self, store: Store, words: list[str], before: str, marks: np.ndarray, first: bool) -> None:
        """Add words that are normal; ``marks`` are the ids that are the first or the last of exactly one word of a row."""
        for at in range(0, len(words), ROW):
            row = words[at : at + ROW]
            ids = self._batch([before + " ".join(row)], True)[0]
            ends = np.append(np.flatnonzero(marks[ids]), len(ids)) if first else np.append(-1, np.flatnonzero(marks[ids])) + 1
            sizes = np.diff(ends)
            if len(sizes) != len(row) or sizes.sum() != len(ids):
                found = self._batch([before + w for w in row], True)
                ids, sizes = np.concatenate(found), np.array([len(x) for x in found])
            store.add(row, ids, sizes)

    def _learn(self, words: list[str]) -> None:
        if self.blanks:
            # an empty word, a blank at the end of a text, would join the next one
            for some in ([""] if "" in words else []), [w for w in words if w]:
                self._rows(self.words, some, " ", self.starts, True)
            return
        plain, other = [], []
        for w in words:
            (plain if w.isascii() or PLAIN.fullmatch(w) else other).append(w)
        for at in range(0, len(other), ROW):
            found = self._batch(other[at : at + ROW])
            self.words.add(other[at : at + ROW], np.concatenate(found), np.array([len(x) for x in found]))
        if not plain:
            return
        if self.pieces.full():
            self.pieces = Store(self.pieces)
        coded = pa.array(PIECES.findall(" ".join(plain).lower())).dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        blank = distinct == " "
        real = np.zeros(len(distinct), dtype=np.int64)
        real[~blank] = self.pieces.places(distinct[~blank], lambda new: self._rows(self.pieces, new, "", self.ends, False))
        between = blank[codes]
        ids, stops = self.pieces.gather(real[codes[~between]])
        ends = np.append(np.flatnonzero(between), len(codes)) - np.arange(len(plain))
        self.words.add(plain, ids, np.diff(stops[ends], prepend=0))

    def _look_up(self, sections: list[str]) -> list[np.ndarray]:
        """Ids of sections; with ``blanks`` every word of a section counts with a blank before it."""
        if self.words.full():
            self.words = Store(self.words)
        column = pa.array(sections, pa.string())
        lists = pc.split_pattern(column, " ") if self.blanks else pc.utf8_split_whitespace(column)
        words, ends = lists.flatten(), lists.offsets.to_numpy()
        if not self.blanks:
            kept = pc.greater(pc.binary_length(words), 0)
            ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[ends]
            words = words.filter(kept)
        coded = words.dictionary_encode()
        place = self.words.places(coded.dictionary.to_numpy(zero_copy_only=False), self._learn)
        ids, stops = self.words.gather(place[coded.indices.to_numpy()])
        cuts = stops[ends]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _sections(self, text: str) -> list[str]:
        """Parts of a text that the library encodes whole, each beginning with the blank that it was cut at."""
        out, at = [], 0
        while len(text) - at > SECTION:
            cut = LONE_BLANK.search(text, at + SECTION)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32 bits) of every text."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        part: list[tuple[int, str]] = []
        chars = 0

        def flush() -> None:
            for (i, _), ids in zip(part, self._look_up([s for _, s in part])):
                done[i].append(ids)
            part.clear()

        for i, text in enumerate(texts):
            if self.whole.search(text):
                done[i] = [self._alone(s) for s in self._sections(text)]
                continue
            at = 0
            if self.blanks:  # the first word has no blank before it
                at = text.find(" ") + 1 or len(text) + 1
                done[i].append(self._head(text[: at - 1]))
            while at <= len(text):
                cut = text.find(" ", at + SLICE)
                cut = len(text) if cut < 0 else cut
                part.append((i, text[at:cut]))
                chars += cut - at
                at = cut + 1
                if chars > SLICE:
                    flush()
                    chars = 0
        if part:
            flush()
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) for ids in done]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        return [ids.tobytes() for ids in self.arrays(texts)]


def encoder(path: str, blanks: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, blanks) not in _ENCODERS:
        _ENCODERS[path, blanks] = Encoder(path, blanks)
    return _ENCODERS[path, blanks]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)

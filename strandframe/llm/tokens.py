"""Batch encoding with the tokenizers library, quick where words repeat.

A byte-level BPE encodes each pre-token by itself, and a space before a visible character always
begins one. So a text is split at its spaces, each distinct piece is encoded once by the library,
and the pieces' ids are joined. Texts where a space is not surely such a border (two spaces in a
row, other white space than space and line feed, a special token's string) go to the library whole.
"""

from __future__ import annotations

import gc
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers, unless told otherwise; further pieces are encoded again each time they occur. An entry takes 150 bytes.
CACHE_ENTRIES = 700_000
#: Characters that are encoded at once, unless told otherwise.
SLICE_CHARS = 4_000_000
#: White space other than space and line feed, by either definition of white space.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Of these characters, letters, digits and white space are the same by any definition.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters that are neither letters nor digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(rf"[\n -~{_LETTER}]+").fullmatch
#: The pre-tokens of byte-level BPE over those characters. Fixed values.
_PRE_TOKENS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+").findall
_LOADED: dict[str, "PieceEncoder"] = {}


def encoder(path: str, entries: int = CACHE_ENTRIES) -> "PieceEncoder":
    """The encoder for a tokenizers file; one for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path, entries)
    return _LOADED[path]


class PieceEncoder:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.entries = entries
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_level = '"type":"ByteLevel","add_prefix_space":false' in self.tokenizer.to_str().replace(" ", "").replace("\n", "")
        self.splits = byte_level and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        vocabulary = self.tokenizer.get_vocab()
        #: By id: the token begins with a space, which byte-level vocabularies write as Ġ.
        self.spaces = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaces[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _borders(self, text: str) -> bool:
        return self.splits and not (
            "  " in text or "\n \n" in text or text.endswith("\n ") or _ODD.search(text) or any(s in text for s in self.special)
        )

    def _spaced(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece with the space before it, from one call; each piece is a word without white space.

        The space goes to the first token of its word, and no other token begins with one.
        """
        e = self.tokenizer.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0]
        ids = np.array(e.ids, dtype=self.dtype)
        begins = np.flatnonzero(self.spaces[ids]) * self.dtype.itemsize
        if len(begins) != len(pieces):
            raise ValueError(f"{len(pieces)} words were encoded as {len(begins)}")
        raw, begins = ids.tobytes(), begins.tolist()
        return dict(zip(pieces, map(raw.__getitem__, map(slice, begins, [*begins[1:], len(raw)]))))

    def _learn(self, words: list[str], pieces: list[str]) -> dict[str, bytes]:
        """Ids of each word (letters alone) and each piece (anything), encoded with the space before it.

        A piece of plain characters is cut into its pre-tokens first, since most of those are known.
        """
        spaced: dict[str, None] = dict.fromkeys(words)
        bare: dict[str, None] = {}
        cut: dict[str, list[str]] = {}
        heads: dict[str, str] = {}  # what follows the space in a cut piece's first pre-token
        out: dict[str, bytes] = {}
        known, known_bare = self.known, self.bare
        for p in pieces:
            if p.isalpha():
                spaced[p] = None
            elif (word := p.rstrip(_MARKS)).isalpha():  # the marks behind a word are one pre-token
                tail = p[len(word) :]
                heads[p], cut[p] = word, [tail]
                if word not in known:
                    spaced[word] = None
                if tail not in known_bare:
                    bare[tail] = None
            elif p and _PLAIN(p):
                parts = cut[p] = _PRE_TOKENS(" " + p)
                if first := parts[0][1:]:
                    heads[p] = first
                    if first not in known:
                        spaced[first] = None
                    del parts[0]
                for x in parts:
                    if x not in known_bare:
                        bare[x] = None
            else:
                out[p] = self._whole(" " + p)
        fresh = self._spaced(list(spaced)) if spaced else {}
        names = list(bare)
        loose = {x: np.array(e.ids, dtype=self.dtype).tobytes() for x, e in zip(names, self.tokenizer.encode_batch_fast(names, add_special_tokens=False))} if names else {}
        for p, parts in cut.items():
            first = heads.get(p)
            ids = (fresh.get(first) or known[first]) if first else b""
            for x in parts:
                ids += loose.get(x) or known_bare[x]
            out[p] = ids
        if len(self.bare) + len(loose) <= self.entries // 4:
            self.bare.update(loose)
        # words are remembered before what is made of them, as long as there is room
        room = self.entries - len(known)
        known.update(itertools.islice(fresh.items(), max(0, room)))
        room = self.entries // 2 - len(known)
        known.update(itertools.islice(out.items(), max(0, room)))
        out.update(fresh)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes (16 bits each if the vocabulary allows, else 32)."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and each collection would walk the lists of pieces
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        rows = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if self._borders(text):
                rows.append(k)
            else:
                out[k] = self._whole(text)
        if not rows:
            return out
        pieces = pc.split_pattern(pa.array([texts[k] for k in rows], pa.large_string()), " ")
        begins = np.asarray(pieces.offsets)
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, names))
        if None in ids:
            lettered = pc.ascii_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False).tolist()
            words = [n for n, x, w in zip(names, ids, lettered) if x is None and w]
            fresh = self._learn(words, [n for n, x, w in zip(names, ids, lettered) if x is None and not w])
            ids = [fresh[n] if x is None else x for n, x in zip(names, ids)]
        first = []  # the first piece of a text has no space before it
        for k in begins[:-1]:
            p = names[coded.indices[int(k)].as_py()]
            if p not in self.bare and len(self.bare) < self.entries // 4:
                self.bare[p] = self._whole(p) if p else b""
            first.append(self.bare[p] if p in self.bare else self._whole(p))
        _, ends, raw = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
        ends, raw = np.frombuffer(ends, np.int64), memoryview(raw)
        for k, x, a, b in zip(rows, first, ends[begins[:-1] + 1].tolist(), ends[begins[1:]].tolist()):
            out[k] = x + raw[a:b]
        return out


def in_slices(values: list, most_chars: int = 1_000_000):
    """Runs of consecutive texts of about most_chars characters at most (one longer text alone)."""
    begin = size = 0
    for k, v in enumerate(values):
        if k > begin and size + len(v) > most_chars:
            yield begin, k
            begin, size = k, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

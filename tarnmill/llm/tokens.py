"""Token ids of whole texts by a public tokenizer of the tokenizers library.

The tokenizer used here cuts texts at white space, between letters and signs, and at every digit,
lower-cases, and only then merges, so a text's ids are those of its units: runs of letters,
runs of signs and single digits; a white-space separated part with an apostrophe or a
character outside ASCII is one unit. Every task keeps the ids of the units it has seen first
(up to ``MEMORY``) in flat arrays, finds all units of a chunk of texts there at once by
128-bit fingerprints, and sends only new units to the library. Texts that name a special token
are encoded whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarnmill.llm.common import bytes_of, give_back, mixed, worker_cache

TOKENIZER = "word_bpe_49k.json"
# units kept, and ids kept for them
MEMORY = 600_000
MEMORY_IDS = 4_000_000
# text bytes encoded at once; a new unit that occurs again within them is sent once
TOKEN_CHUNK = 2_000_000
# new units sent in one call
CALL = 4000
# longer units are hashed one by one
LONG = 256

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
KIND = np.where(_BLANK, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, 3))).astype(np.uint8)
# bytes whose part is one unit: the apostrophe, and those of other code points
TIED = (_BYTES >= 128) | (_BYTES == 39)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
# the first k bytes of a little-endian word
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SECOND = np.uint64(0xD1342543DE82EF95)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def units_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, whether its part is tied) of the units of texts that lie one behind the other."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = KIND[data]
    inside = kind > 0
    opens, changes = inside.copy(), kind == 2
    opens[1:] &= ~inside[:-1]
    changes[1:] |= kind[1:] != kind[:-1]
    cuts = bounds[:-1][bounds[:-1] < n]
    opens[cuts] = inside[cuts]
    part_start = np.flatnonzero(opens)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | opens[1:]
    part_stop = np.flatnonzero(ends) + 1
    tied = np.zeros(len(part_start), bool)
    tied[np.searchsorted(part_start, np.flatnonzero(TIED[data]), side="right") - 1] = True
    starts = np.flatnonzero((changes & inside) | opens)
    first = opens[starts]
    part = np.cumsum(first) - 1
    keep = first | ~tied[part]
    starts, first, part = starts[keep], first[keep], part[keep]
    last = np.append(first[1:], True)[: len(starts)]
    stops = np.where(last, part_stop[part], np.append(starts[1:], n)[: len(starts)])
    return starts, stops, tied[part]


def fingerprints(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every span of bytes, eight bytes at a time."""
    sizes = stops - starts
    a = mixed(sizes.astype(np.uint64))
    b = a * SECOND
    words = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    live = np.flatnonzero(sizes <= LONG)
    k = 0
    while len(live):
        value = words[starts[live] + k] & FIRST_BYTES[np.minimum(sizes[live] - k, 8)]
        a[live] = mixed(a[live] ^ value)
        b[live] = mixed((b[live] + value) * SECOND)
        k += 8
        live = live[sizes[live] > k]
    for long in np.flatnonzero(sizes > LONG).tolist():
        a[long], b[long] = np.frombuffer(hashlib.blake2b(data[starts[long] : stops[long]].tobytes(), digest_size=16).digest(), "<u8")
    return a, b


class Fingerprints:
    """Places 0, 1, ... of distinct fingerprints, in a table with open addresses."""

    def __init__(self, most: int):
        size = 1 << max(4, (2 * most - 1).bit_length())
        self.table, self.mask, self.n = np.full(size, -1, np.int32), np.uint64(size - 1), 0
        self.a, self.b = np.zeros(most, np.uint64), np.zeros(most, np.uint64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each fingerprint, or -1."""
        out, at = np.full(len(a), -1, np.int64), (a & self.mask).astype(np.int64)
        live = np.arange(len(a))
        while len(live):
            place = self.table[at[live]]
            live, place = live[place >= 0], place[place >= 0]
            same = (self.a[place] == a[live]) & (self.b[place] == b[live])
            out[live[same]] = place[same]
            live = live[~same]
            at[live] = (at[live] + 1) & len(self.table) - 1
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give the next places to new, distinct fingerprints."""
        self.a[self.n : self.n + len(a)], self.b[self.n : self.n + len(a)] = a, b
        at, live = (a & self.mask).astype(np.int64), np.arange(len(a))
        while len(live):
            free = live[self.table[at[live]] < 0]
            # of those that want one address the last gets it
            self.table[at[free]] = self.n + free
            live = live[self.table[at[live]] != self.n + live]
            at[live] = (at[live] + 1) & len(self.table) - 1
        self.n += len(a)


class Encoder:
    """Ids of texts as one array with bounds; keeps the ids of known units one behind the other."""

    def __init__(self, path: str):
        # tasks share the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        # ids that end a word of the tokenizer
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"\z\A."
        self.known = Fingerprints(MEMORY)
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit) of units that are one word to the tokenizer."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(units).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(units) or ends[-1] != len(ids):
            return self.parts(units)
        return ids, np.diff(ends, prepend=0)

    def parts(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit) of any units."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        return np.array([i for own in found for i in own], np.uint32), np.array([len(own) for own in found], np.int64)

    def learn(self, units: list[bytes], n_words: int) -> None:
        """Put the ids of new units, words first, behind those of the known ones."""
        done = [self.words(units[k : min(k + CALL, n_words)]) for k in range(0, n_words, CALL)]
        done += [self.parts(units[k : k + CALL]) for k in range(n_words, len(units), CALL)]
        ids, lengths = (np.concatenate(both) for both in zip(*done))
        n, stop = self.known.n, self.used + len(ids)
        self.begin, self.length, self.ids = grown(self.begin, n + len(units)), grown(self.length, n + len(units)), grown(self.ids, stop)
        self.begin[n : n + len(units)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(units)] = lengths
        self.ids[self.used : stop] = ids

    def places(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Where ``begin`` and ``length`` tell of each unit, valid until the next call."""
        a, b = fingerprints(data, starts, stops)
        place = self.known.find(a, b)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            order = missing[np.lexsort((b[missing], a[missing], tied[missing]))]
            differs = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
            new, n = order[differs], self.known.n
            place[order] = n + np.cumsum(differs) - 1
            raw = data.tobytes()
            self.learn([raw[i:j] for i, j in zip(starts[new].tolist(), stops[new].tolist())], int((~tied[new]).sum()))
            ids = int(self.length[n : n + len(new)].sum())
            # frequent units come early and are kept; later ones are overwritten
            if n + len(new) <= MEMORY and self.used + ids <= MEMORY_IDS:
                self.known.add(a[new], b[new])
                self.used += ids
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of every text in them); null texts have no ids."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        whole = {k: self.whole(texts[k].as_py()) for k in np.flatnonzero(special).tolist()}
        data, text_bounds = bytes_of(pc.if_else(pa.array(special), "", texts) if whole else texts)
        data = LOWER[data]
        starts, stops, tied = units_of(data, text_bounds)
        place = self.places(data, starts, stops, tied)
        begins, lengths = self.begin[place], self.length[place]
        ends = np.append(0, np.cumsum(lengths))
        ids = self.ids[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(starts, text_bounds)]
        if whole:
            pieces = [whole.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
            bounds = np.append(0, np.cumsum([len(p) for p in pieces]))
            ids = np.concatenate(pieces)
        return ids, bounds


def grown(array: np.ndarray, size: int) -> np.ndarray:
    if len(array) >= size:
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it keeps one."""
    cache = worker_cache()
    if cache.get("encoder", ("", None))[0] != path:
        # a worker that has moved on to tokens needs no tables for words
        for name in [key for key in cache if isinstance(key, tuple) and key[0] == "powers"]:
            del cache[name]
        gc.collect()
        give_back()
        cache["encoder"] = (path, Encoder(path))
    return cache["encoder"][1]


def encode_with_end(path: str, end: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to (ids, bounds) with the id ``end`` after every text."""
    of = encoder(path)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = of.encode(texts)
        with_end = np.insert(ids, bounds[1:], end).astype(np.uint32)
        return with_end, bounds + np.arange(len(bounds))

    return encode

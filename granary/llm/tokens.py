"""Token ids by the tokenizers library, with each distinct pre-token encoded once per worker.

Byte-pair merges never cross pre-token borders, so the ids of a text are those of its pre-tokens in order.  Where a
tokenizer file has one of the two pre-token rules that are known here, the borders of a chunk of texts are found in numpy,
a pre-token is found by the hash of its bytes and known by the bytes themselves, and the library encodes those that are new.
Texts with other characters than ASCII and accented Latin-1 letters, texts that hold the string of an added token (such as
``<|endoftext|>``, which the library gives an id of its own), texts with a pre-token whose hash another one has, and all texts of
other tokenizers go through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import kernel as K

#: Distinct pre-tokens that a worker remembers; when there are more it starts anew.  Slots of the table that finds them.
KNOWN, SLOTS = 1_000_000, 1 << 21
#: Pre-tokens that the library is given at once.
STEP = 5_000

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[K.SPACE] = SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = LETTER
_CLASS[48:58] = DIGIT
#: Lower case of ASCII and, as second bytes after 0xC3, of accented Latin-1 letters.
_LOWER = K.LOWER.copy()
_LOWER[[x for x in range(0x80, 0x9F) if x != 0x97]] += 0x20
_FOLD = _LOWER.tobytes()
# The contractions of both pre-token rules, in their order.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _rule(spec: dict) -> str | None:
    """Which pre-token rule a tokenizer file has: 'words' (lower case, no white space), 'bytes' (a space goes with what follows), or None."""
    normalizer, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": known} and split.get("invert") and split.get("behavior") == "Removed":
        return "words"
    return None


def plain_documents(c: K.Chunk) -> np.ndarray:
    """Which documents have only ASCII (no control characters but white space) and accented Latin-1 letters."""
    d = c.data
    odd = ((d >= 0xC0) & (d != 0xC3)) | ((d < 0x20) & ~K.SPACE[d]) | (d == 0x7F)
    sign = np.flatnonzero(d == 0xC3)
    odd[sign[np.isin(d[sign + 1], (0x97, 0xB7))]] = True  # the signs of multiplication and division
    return K.sums_of(odd, c.offsets) == 0


def borders(c: K.Chunk, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain documents, in bytes."""
    d, n = (_LOWER[c.data] if rule == "words" else c.data), len(c.data)
    kind = _CLASS[d]
    begin = np.zeros(n, bool)  # documents
    begin[c.offsets[:-1][np.diff(c.offsets) > 0]] = True
    flag = begin.copy()
    flag[1:] |= kind[1:] != kind[:-1]
    fresh = flag.copy()
    if rule == "words":
        flag |= kind == DIGIT
    else:
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~begin[1:]) + 1
        flag[after - 1] = True
        flag[after[d[after - 1] == 0x20]] = False
    quote = np.flatnonzero((d == 0x27) & flag & fresh)
    if len(quote):
        later = np.append(np.flatnonzero(begin), n)
        end = later[np.searchsorted(later, quote, "right")]
        taken = np.zeros(len(quote), bool)
        for letters in CONTRACTIONS:
            fits = ~taken & (quote + 1 + len(letters) <= end)
            for k, x in enumerate(letters):
                fits[fits] = d[quote[fits] + 1 + k] == x
            taken |= fits
            at = quote[fits] + 1
            flag[at] = False
            behind = at + len(letters)
            behind = behind[(behind < end[fits]) & (kind[np.minimum(behind, n - 1)] != SPACE)]
            flag[behind] = True
    start = np.flatnonzero(flag)
    end = np.append(start[1:], n) if len(start) else start
    if rule == "words":
        solid = kind[start] != SPACE
        return start[solid], end[solid]
    return start, end


class Table:
    """Pre-tokens, by their 64-bit hashes, to runs of ids; open addressing, all in arrays.  Their bytes are kept end to end in `data`."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.key, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.n, self.used = np.zeros(1 << 18, self.dtype), 0, 0
        self.data, self.begin, self.end = np.zeros(1 << 20, np.uint8), np.zeros(1 << 16, np.int64), 0
        self.length = np.zeros(1 << 16, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash (never 0), or -1."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        key = self.key[slot]
        out = np.where(key == h, self.at[slot], -1)
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
            key = self.key[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def holds(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each entry's pre-token has the bytes [start, end) of `data`."""
        size = end - start
        good = self.length[entry] == size
        good[good] = K.equal_spans(self.data[: self.end], self.begin[entry[good]], data, start[good], size[good])
        return good

    def add(self, h: np.ndarray, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new hashes, their pre-tokens, and their ids end to end."""
        n, used = self.n + len(h), self.used + len(ids)
        if n > len(self.first):
            self.first, self.size, self.begin, self.length = (np.resize(x, 2 * n) for x in (self.first, self.size, self.begin, self.length))
        raw, lengths = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        if self.end + len(raw) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.end + len(raw)))
        self.data[self.end : self.end + len(raw)] = raw
        self.begin[self.n : n], self.length[self.n : n] = self.end + np.cumsum(lengths) - lengths, lengths
        self.end += len(raw)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.ids[self.used : used] = ids
        self.first[self.n : n], self.size[self.n : n] = self.used + np.cumsum(sizes) - sizes, sizes
        slot, rest = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(rest):
            free = rest[self.key[slot[rest]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.at[slot[put]] = h[put], self.n + put
            rest = rest[self.key[slot[rest]] != h[rest]]
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
        self.n, self.used = n, used


class Encoder:
    """Ids of whole texts; one encoder a process, file and dtype."""

    _known: dict[tuple[str, str], Encoder] = {}

    def __new__(cls, path: str, dtype: str = "<u4") -> Encoder:
        if (path, dtype) not in cls._known:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            self = super().__new__(cls)
            self.tokenizer, self.dtype, self.table = Tokenizer.from_file(path), dtype, None
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.rule = _rule(spec)
            # strings that the library takes out of a text before any rule; upper and lower case are one, as some are looked for in normalised texts
            self.added = [a["content"].encode().translate(_FOLD) for a in spec.get("added_tokens") or [] if a.get("content")]
            if self.rule:
                # pre-tokens are folded and split already; what is left of these steps is the mapping of bytes
                self.parts, self.table = Tokenizer.from_file(path), Table(dtype)
                self.parts.normalizer, self.parts.pre_tokenizer = None, ByteLevel(add_prefix_space=False, use_regex=False)
            cls._known[path, dtype] = self
        return cls._known[path, dtype]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        for at in range(0, len(words), STEP):
            some = words[at : at + STEP]
            e = self.parts.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            self.table.add(h[at : at + STEP], some, np.array(e.ids, self.dtype), sizes)

    def _plain(self, c: K.Chunk) -> np.ndarray:
        """Which documents have pre-tokens that are found here."""
        if not self.rule:
            return np.zeros(len(c.offsets) - 1, bool)
        plain, raw = plain_documents(c), None
        for token in self.added:
            raw = raw or c.data.tobytes().translate(_FOLD)
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(c.offsets, at, "right") - 1] = False
                at = raw.find(token, at + 1)
        return plain

    def encode(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunk's documents end to end, where each begins, n + 1)."""
        n, plain = len(c.offsets) - 1, self._plain(c)
        bounds, ids = np.zeros(n + 1, np.int64), np.zeros(0, self.dtype)
        if plain.any():
            start, end = borders(c, self.rule)
            doc = np.searchsorted(c.offsets, start, "right") - 1
            if not plain.all():
                own = plain[doc]
                start, end, doc = start[own], end[own], doc[own]
            folded = _LOWER[c.data] if self.rule == "words" else c.data
            h = K.hashed(folded, start, end) | np.uint64(1)
            entry = self.table.find(h)
            new = np.flatnonzero(entry < 0)
            if len(new):
                if self.table.n + len(new) > KNOWN:
                    self.table.clear()
                    new = np.arange(len(h))
                fresh, one = np.unique(h[new], return_index=True)
                at = new[one]
                raw = folded.tobytes()
                self._learn(fresh, [raw[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)])
                entry[new] = self.table.find(h[new])
            if not (good := self.table.holds(entry, folded, start, end)).all():
                plain[doc[~good]] = False
                own = plain[doc]
                entry, doc = entry[own], doc[own]
            sizes = self.table.size[entry]
            ahead = np.cumsum(sizes) - sizes
            ids = self.table.ids[np.repeat(self.table.first[entry] - ahead, sizes) + np.arange(int(sizes.sum()))]
            bounds[1:] = np.cumsum(np.bincount(doc, sizes, minlength=n).astype(np.int64))
        if plain.all():
            return ids, bounds
        raw = c.data.tobytes()
        each = [ids[bounds[i] : bounds[i + 1]] if plain[i] else self.whole(raw[c.offsets[i] : c.offsets[i + 1]].decode()) for i in range(n)]
        return np.concatenate([np.zeros(0, self.dtype), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

"""Token ids of whole texts, by the tokenizers library, with a memo of the pieces it has seen.

Byte-pair tokenizers of the two kinds that `known` recognises split on white space and give a text the same ids as its pieces between
white space, one after another. So each distinct piece is encoded once per worker and remembered:
natural text repeats its words, and encoding is by far the dearest step. A piece that is a Latin
word with signs behind it is put together from the ids of both, and new words go to the library
many at a time. Where white space belongs to no token, words and signs are cut, lower-cased, looked
up and remembered as arrays, without a Python object for each. Texts in
which white space could join pieces (several in a row, or of a kind other than blanks and line
ends) go to the library as they are, and so do all texts with any other tokenizer. Special tokens that
a text spells out are what the library makes of them.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernel

#: Entries after which a memo becomes the old one, whose entries are forgotten unless they are asked for again: two of these
#: bound a worker's memory.
MEMO_ENTRIES = 500_000
#: Pieces beyond this length aren't kept.
MEMO_CHARS = 64
#: Pieces that go to the library in one call.
JOINED = 512
#: Bytes of text that are cut into pieces at a time: repeated pieces are looked up once.
SLICE = 8 << 20

#: White space other than blank, tab and line ends, on whose meaning the library's patterns differ from Python's.
_ODD_SPACE = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


#: Latin letters (composed, one lower-case letter each).
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u024f]+")
#: ASCII signs and digits but no apostrophe: the tokenizers' patterns always part these from letters before them.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha() and chr(c) != "'")


#: Kinds of bytes: white space that parts pieces, letters, signs, anything else; letters of two bytes are found by their code.
_GAP, _LETTER, _SIGN, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[ord(" "), ord("\n")]] = _GAP
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KINDS[[ord(c) for c in _SIGNS]] = _SIGN
_LETTERS = np.array([_WORD.fullmatch(chr(c)) is not None for c in range(0x280)])


# What the two kinds of tokenizer files say of themselves.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_LEVEL = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "pre_tokenizer": ["Split", "ByteLevel"],
}


def known(file: dict, spaced: bool) -> bool:
    """Whether texts may be cut at white space: the file's patterns are those of its kind, and no added token fits a word with signs behind it."""
    for token in file.get("added_tokens") or []:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or not re.search(r"[^A-Za-z\s][^\s]*[A-Za-z]", token["content"]):
            return False
    if file["model"]["type"] != "BPE" or file.get("post_processor"):
        return False
    if spaced:
        return file["normalizer"] is None and file["pre_tokenizer"] == BYTE_LEVEL
    normalizer, before = file["normalizer"] or {}, file["pre_tokenizer"] or {}
    steps = before.get("pretokenizers") or [{}]
    return (
        [x["type"] for x in normalizer.get("normalizers", [])] == WORD_LEVEL["normalizer"]
        and [x.get("type") for x in steps] == WORD_LEVEL["pre_tokenizer"]
        and steps[0].get("pattern") == {"Regex": WORD_LEVEL["pattern"]}
    )


def latin_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at blanks and line ends, and between a Latin word and signs that are all that follows it: the pieces that
    aren't empty, whether each is a Latin word (its A-Z are lower-cased), and the pieces before each text.
    """
    raw, offsets = kernel.bytes_of(texts)
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    kinds = _KINDS[raw]
    two = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
    two = two[_LETTERS[(raw[two] & 0x1F).astype(np.int64) << 6 | raw[two + 1] & 0x3F]]
    kinds[two] = kinds[two + 1] = _LETTER

    inside = kinds != _GAP
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]  # a piece never goes on from one text to the next
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    # pieces of letters, then signs
    simple = np.maximum.reduceat(kinds, starts) != _OTHER
    turn = np.flatnonzero((kinds[1:] != kinds[:-1]) & ~first[1:] & inside[1:]) + 1
    owner = np.searchsorted(starts, turn, side="right") - 1
    simple[owner[kinds[turn] == _LETTER]] = False
    cuts = turn[simple[owner]]
    word = np.zeros(len(raw), bool)
    word[starts[simple & (kinds[starts] == _LETTER)]] = True
    first[cuts] = True
    starts = np.flatnonzero(first)
    latin = word[starts]

    capitals = np.flatnonzero((raw >= 65) & (raw <= 90))
    capitals = capitals[latin[np.searchsorted(starts, capitals, side="right") - 1]]
    lower = raw.copy()
    lower[capitals] += 32
    bounds = np.append(0, np.cumsum(np.add.reduceat(inside, starts, dtype=np.int64)))  # where white space is left out
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(lower[inside]))
    return pieces, latin, np.searchsorted(starts, offsets)


def _spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Memo:
    """Pieces and their ids, as arrays."""

    def __init__(self):
        self.pieces = pa.array([], pa.large_string())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, or -1."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def add(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Remembers pieces; their places."""
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        return np.arange(len(self) - len(pieces), len(self))


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    spaced: white space belongs to tokens (byte-level vocabularies); otherwise it is dropped.
    """

    def __init__(self, path: str, spaced: bool, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.entries = spaced, entries
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.known = known(whole, spaced)
        self.mark = self.whole("\n") if spaced else b""
        self.memo: dict[str, bytes] | Memo = {} if spaced else Memo()
        self.old: dict[str, bytes] | Memo = {} if spaced else Memo()
        self.tails: dict[str, bytes] = {}
        self.long: list[str] = []  # words too long to keep
        # the same merges for words that need no further splitting; no cache, for each is encoded once
        own = whole["model"] if self.known else {"vocab": {}, "merges": []}
        kept = {k: own[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk") if own.get(k) is not None}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["merges"]]
        self.model = Tokenizer(BPE(own["vocab"], merges, cache_capacity=0, **kept))
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {x for c in map(chr, range(ord("A"), 0x250)) if _WORD.fullmatch(c) for x in (c, c.lower())}
        self.bytes_of = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self.blank = level.pre_tokenize_str(" ")[0][0] if spaced else ""
        # whether an id ends a word, where tokens say so
        suffix = kept.get("end_of_word_suffix")
        self.last = np.zeros(1 + max(own["vocab"].values(), default=0), bool)
        self.last[[i for t, i in own["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _words(self, words: list[str]) -> None:
        """Remembers the ids of Latin words after a blank, or after the line end that they begin with."""
        blank, bytes_of, mark, memo = self.blank, self.bytes_of, self.mark, self.memo
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            lines = [w[1:].translate(bytes_of) if w[0] == "\n" else blank + w.translate(bytes_of) for w in part]
            found = self.model.encode("\n".join(lines), add_special_tokens=False)
            raw = np.asarray(found.ids, dtype="<u4").tobytes()
            cuts = (4 * np.flatnonzero(np.diff(np.asarray(found.word_ids, dtype=np.int64), prepend=-1))).tolist()
            memo.update((w, mark + raw[a:b] if w[0] == "\n" else raw[a:b]) for w, a, b in zip(part, cuts, [*cuts[1:], len(raw)]))

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces without white space (but for the line end that they may begin with)."""
        memo, tails = self.memo, self.tails
        split, new = [], set()
        for p in pieces:
            base = p.rstrip(_SIGNS)
            if _WORD.fullmatch(base, base[:1] == "\n"):
                if base not in memo:
                    new.add(base)
                if len(base) < len(p):
                    split.append((p, base))
            else:
                memo[p] = self.whole(p if p[0] == "\n" else " " + p)
        self._words(list(new))
        if len(tails) + len(split) > self.entries:
            tails.clear()
        for p, base in split:
            tail = p[len(base) :]
            if tail not in tails:
                tails[tail] = self.whole(tail)
            memo[p] = memo[base] + tails[tail]
        self.long = [base for base in new if len(base) > MEMO_CHARS]

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Texts cut at blanks and line ends; a line end stays before its piece, and the first piece gets one."""
        lines = pc.replace_substring(texts, "\n", " \n")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), lines, pa.scalar("", pa.large_string())), " ")

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty)."""
        out: list[bytes] = []
        encode = self._encode_spaced if self.spaced else self._encode_words
        for _, part in kernel.slices(texts, SLICE):
            part = pc.fill_null(part, "").cast(pa.large_string())
            out += encode(part) if self.known else [self.whole(t) for t in part.to_pylist()]
        return out

    def _latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of Latin words."""
        cuts = [*range(0, len(words), JOINED), len(words)]
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar("\n", pa.large_string())).to_pylist()
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for line, a, b in zip(lines, cuts, cuts[1:]):
            line = line.lower().translate(self.bytes_of)
            found = np.asarray(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != b - a:  # tokens don't tell where words end
                ends = np.searchsorted(np.asarray(self.model.encode(line, add_special_tokens=False).word_ids, dtype=np.int64), np.arange(b - a), side="right")
            sizes.append(np.diff(ends, prepend=0))
            ids.append(found)
        return np.concatenate(sizes), np.concatenate(ids)

    def _wholes(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of any pieces."""
        found = [self._ids(p) for p in pieces.to_pylist()]
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate([np.zeros(0, "<u4"), *found])

    def _encode_words(self, texts: pa.Array) -> list[bytes]:
        pieces, latin, edges = latin_pieces(texts)
        distinct = pieces.dictionary_encode()
        names, index = distinct.dictionary, distinct.indices.to_numpy()
        if len(self.memo) > self.entries:
            self.old, self.memo = self.memo, Memo()
        memo, old, passing = self.memo, self.old, Memo()  # passing: what isn't kept
        at, odd = memo.find(names), np.zeros(len(names), bool)
        if len(new := np.flatnonzero(at < 0)):
            there = old.find(names.take(pa.array(new)))
            again, new = new[there >= 0], new[there < 0]
            there = there[there >= 0]
            at[again] = memo.add(names.take(pa.array(again)), old.sizes[there], _spread(old.ids, old.starts[there], old.sizes[there]))
            is_latin, long = np.zeros(len(names), bool), pc.greater(pc.utf8_length(names), MEMO_CHARS).to_numpy(zero_copy_only=False)
            is_latin[index] = latin
            words, others = new[is_latin[new]], new[~is_latin[new]]
            # pieces that tell of white space of another kind send their texts to the library
            odd[others] = [_ODD_SPACE.search(p) is not None for p in names.take(pa.array(others)).to_pylist()]
            aside = long | odd
            for where, some in ((memo, ~aside), (passing, aside)):
                for group, ids_of in ((words, self._latin), (others[~odd[others]], self._wholes)):
                    group = group[some[group]]
                    part = names.take(pa.array(group))
                    at[group] = where.add(part, *ids_of(part))
                    if where is passing:
                        at[group] += len(memo)
        # ids of all words: those of the distinct pieces, copied to where the pieces stand
        sizes = np.append(np.concatenate((memo.sizes, passing.sizes)), 0)[at]  # -1: pieces of texts that the library gets
        starts = np.append(np.concatenate((memo.starts, len(memo.ids) + passing.starts)), 0)[at]
        many = sizes[index]
        raw = _spread(np.concatenate((memo.ids, passing.ids)), starts[index], many).tobytes()
        cuts = 4 * np.concatenate(([0], np.cumsum(many)))[edges]
        found = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for i in np.unique(np.searchsorted(edges, np.flatnonzero(odd[index]), side="right") - 1):
            found[i] = self.whole(texts[int(i)].as_py())
        return found

    def _encode_spaced(self, texts: pa.Array) -> list[bytes]:
        pieces = self._pieces(texts)
        words = pieces.flatten().dictionary_encode()
        names, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        ids = list(map(self.memo.get, names))
        odd: set[str] = set()
        if None in ids:
            if len(self.memo) > self.entries:
                self.old, self.memo = self.memo, {}
            memo = self.memo
            new = []
            for p in [p for p, i in zip(names, ids) if i is None]:
                known = self.old.get(p)
                if known is None:
                    new.append(p)
                else:
                    memo[p] = known
            # pieces that tell of white space of another kind, or several in a row, send their texts to the library
            odd.update(p for p in new if _ODD_SPACE.search(p) or p in ("", "\n"))
            memo.update(dict.fromkeys(odd, b""))
            self._learn([p for p in new if p and p not in odd])
            ids = [memo[p] if i is None else i for p, i in zip(names, ids)]
            for p in [*(p for p in new if p in odd or len(p) > MEMO_CHARS), *self.long]:
                memo.pop(p, None)
        # ids of all words: those of the distinct pieces, copied to where the pieces stand
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        many = sizes[index]
        copied = _spread(flat, starts[index], many)
        edges = pieces.offsets.to_numpy()
        edges = edges - edges[0]
        cuts = np.concatenate(([0], np.cumsum(many)))[edges]
        raw, skip = copied.tobytes(), len(self.mark)
        found = [raw[a + skip : b] for a, b in zip((4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist())]
        if odd:
            bad = np.array([p in odd for p in names])[index]
            for i in np.flatnonzero(np.add.reduceat(np.append(bad, 0), edges[:-1]) * (np.diff(edges) > 0)):
                found[i] = self.whole(texts[int(i)].as_py())
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool, entries: int = MEMO_ENTRIES) -> Encoder:
    """One for each worker process."""
    return Encoder(path, spaced, entries)


def forget() -> None:
    """Frees what this worker remembers: for tasks of other operators that follow in the same process."""
    encoder.cache_clear()
    kernel.release()

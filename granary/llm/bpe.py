"""Byte-level BPE ids at array speed: the tokenizers library encodes each distinct piece once.

Texts are cut into pre-tokens by array operations that follow the vocabulary's own splitting
pattern; the library encodes those not seen before, and ids are gathered from that cache.
Texts with code points outside the plain Latin, Greek and Cyrillic range, or with the string
of a special token, go to the library whole, so ids are the library's for every text.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from granary.llm.bytescan import U, mix, segment_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points below this have settled classes; texts with others are encoded whole.
SAFE = 0x530


def _class(c: int) -> int:
    ch = chr(c)
    if ch.isspace() and not 0x1C <= c <= 0x1F:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(ch)[0], OTHER)


_CLASS = np.array([_class(c) for c in range(SAFE)], dtype=np.uint8)
_VALUE = mix(np.arange(1, SAFE + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))


def pretoken_starts(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of many texts; begins: where each text does, and the end."""
    n = len(chars)
    cls = _CLASS[chars]
    first = np.zeros(n + 3, dtype=bool)
    first[begins[:-1][begins[:-1] < n]] = True
    start = np.zeros(n + 3, dtype=bool)
    start[:n] = first[:n]
    start[1:n] |= cls[1:] != cls[:-1]
    # The last of some white space before other characters stands apart, a blank joins what follows.
    after = np.flatnonzero(start[1:n] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[chars[after - 1] == 0x20]] = False
    # English contractions after an apostrophe that starts a pre-token.
    at = np.flatnonzero((chars == 0x27) & start[:n])
    if len(at):
        pad = np.concatenate([chars, np.zeros(3, dtype=chars.dtype)])
        a, b = pad[at + 1], pad[at + 2]
        in1 = ~first[at + 1]
        in2 = in1 & ~first[at + 2]
        one = in1 & np.isin(a, [ord(c) for c in "stmd"])
        two = in2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[at[one] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 1] = False
        start[at[two] + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of batches of texts, with a bounded cache of pre-tokens."""

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.most = Tokenizer.from_file(path), most
        self.special = [str(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.mark = self.lib.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.len = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        plain = [i for i, p in enumerate(pieces) if "\n" not in p]
        rest = [i for i, p in enumerate(pieces) if "\n" in p]
        lens = np.zeros(len(pieces), dtype=np.int64)
        ids: list = [None] * len(pieces)
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            got = np.array(self.lib.encode_batch_fast(["\n" + "\n".join(pieces[i] for i in part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = np.flatnonzero(got == self.mark[0])
            if len(self.mark) != 1 or len(cut) != len(part):
                rest += part
                continue
            for i, a, b in zip(part, cut.tolist(), [*cut[1:].tolist(), len(got)]):
                ids[i] = got[a + 1 : b]
        for i, e in zip(rest, self.lib.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False) if rest else []):
            ids[i] = np.array(e.ids, dtype=np.uint32)
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        at = len(self.flat) + np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.flat = np.concatenate([self.flat, *ids])
        keys, at, lens = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.len, lens])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.len = keys[order], at[order], lens[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids begin (and the end)."""
        n = len(texts)
        if n == 0:
            return np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=n))])
        whole = np.zeros(n, dtype=bool)
        odd = np.flatnonzero(chars >= SAFE)
        whole[np.searchsorted(begins, odd, side="right") - 1] = True
        for i, t in enumerate(texts):
            if not whole[i] and any(s in t for s in self.special):
                whole[i] = True
        if not whole.any():
            return self._plain(chars, begins, texts)
        easy = [t for t, w in zip(texts, whole) if not w]
        flat, at = self._plain(np.frombuffer("".join(easy).encode("utf-32-le"), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in easy])]).astype(np.int64), easy)
        parts, k = [], 0
        hard = iter(self.lib.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
        for w in whole:
            if w:
                parts.append(np.array(next(hard).ids, dtype=np.uint32))
            else:
                parts.append(flat[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _plain(self, chars: np.ndarray, begins: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(chars) == 0:
            return np.empty(0, dtype=np.uint32), np.zeros(len(begins), dtype=np.int64)
        starts = pretoken_starts(chars, begins)
        ends = np.concatenate([starts[1:], [len(chars)]])
        hashes = segment_hash(_VALUE[chars], starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        new = place >= len(self.keys)
        new[~new] = self.keys[place[~new]] != keys[~new]
        if new.any():
            text = "".join(texts)
            self._learn(keys[new], [text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self.keys, keys)
        at, lens = self.at[place][inverse], self.len[place][inverse]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(at - total[:-1], lens) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, begins)]


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]

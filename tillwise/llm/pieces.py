"""A SentencePiece vocabulary as numpy tables, shared by token counting and sampling.

A text becomes ``▁`` plus the text with spaces as ``▁``. Where no piece of the
vocabulary has two neighbouring characters side by side, no token can span
them, so a text falls apart there into independent pre-tokens.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np

SPACE = "▁"
# A pre-token at word level: spaces and the characters after them. Exact for vocabularies without a piece that has a
# space after another character, which ``Pieces`` checks.
WORDS = re.compile(" +[^ ]*")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Index:
    """Place of a number in a list of distinct non-negative numbers: open addressing, probed for whole arrays at once."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(numbers) + 1))) + 3)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int64)
        numbers = np.asarray(numbers, dtype=np.int64)
        slot, open_ = self._slot(numbers), np.arange(len(numbers))
        while len(open_):
            # Of those that want one free slot, the first takes it; the others go on to the next.
            free = open_[self.keys[slot[open_]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.at[slot[taken]] = numbers[taken], taken
            open_ = open_[self.keys[slot[open_]] != numbers[open_]]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        mixed = numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """Places, -1 for numbers not in the list."""
        slot = self._slot(np.ascontiguousarray(numbers, dtype=np.int64))
        held = self.keys[slot]
        found = np.where(held == numbers, self.at[slot], -1)
        open_ = np.flatnonzero((held != numbers) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            match = held == numbers[open_]
            found[open_[match]] = self.at[slot[open_[match]]]
            open_ = open_[~match & (held != -1)]
        return found


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.size = size
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.ids = {t: i for i, t in self.text.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        scores = np.array([model.get_score(i) for i in plain])
        # Best score first; equal scores share a rank.
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = dict(zip(plain, rank.tolist(), strict=True))
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece has a space after another character; texts cannot be cut into words")

    @cached_property
    def _chars(self) -> dict[str, int]:
        """A symbol id for each single character in any piece: its own id, or one past the vocabulary."""
        singles = {t: i for t, i in self.ids.items() if len(t) == 1}
        others = sorted({c for t in self.ids for c in t} - singles.keys())
        return singles | {c: self.size + n for n, c in enumerate(others)}

    @cached_property
    def char_table(self) -> np.ndarray:
        """Symbol id of each code point, -1 for characters in no piece."""
        table = np.full(0x110000, -1, dtype=np.int32)
        for ch, i in self._chars.items():
            table[ord(ch)] = i
        return table

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return self.char_table[codes].astype(np.int64)

    @cached_property
    def bigrams(self) -> Index:
        """Pairs of symbol ids of neighbours inside some piece, as one number each."""
        c = self._chars
        return Index(np.unique([(c[t[i]] << 20) | c[t[i + 1]] for t in self.ids for i in range(len(t) - 1)]))

    @cached_property
    def merges(self) -> tuple[Index, np.ndarray, np.ndarray]:
        """Pairs of symbol ids (as one number), the rank and the id of the piece that they make."""
        known = self.ids | self._chars
        found = {}
        for text, made in self.ids.items():
            for i in range(1, len(text)):
                a, b = known.get(text[:i]), known.get(text[i:])
                if a is not None and b is not None:
                    found[(a << 20) | b] = made
        pairs = np.array(sorted(found), dtype=np.int64)
        made = np.array([found[p] for p in pairs.tolist()], dtype=np.int64)
        return Index(pairs), np.array([self.rank[i] for i in made.tolist()], dtype=np.int64), made

    @cached_property
    def trie(self) -> tuple[Index, np.ndarray, np.ndarray]:
        """(node, symbol) keys, the next node of each, and the piece that ends at each node (-1: none). Root 0."""
        nodes, ends = {}, [-1]
        for text, piece in self.ids.items():
            at = 0
            for ch in text:
                key = (at << 20) | self._chars[ch]
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = piece
        keys = np.array(sorted(nodes), dtype=np.int64)
        return Index(keys), np.array([nodes[k] for k in keys.tolist()], dtype=np.int64), np.array(ends, dtype=np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def words(text: str) -> list[str]:
    """The pre-tokens of a text at word level, with plain spaces."""
    return WORDS.findall(" " + text.replace(SPACE, " ")) if text else []


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, spaces as ``▁``, and where each text starts (one more at the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.where(codes == 0x20, ord(SPACE), codes), starts

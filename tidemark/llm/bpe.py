"""BPE encoding and decoding with the vocabulary file of a word-level byte BPE tokenizer.

Encoding is by backtracking: an Aho-Corasick automaton gives the longest token that matches at each position of a
word, a table of compatible neighbours tells whether two adjacent tokens survive merging, and where the next token
does not fit, its longest shorter prefix is tried before the token in front is given up. No position is given up
twice, so the work is linear in the word's length, and the tokens are exactly those of the merge rules.
Decoding reads one string of all tokens by an offset table.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows give repeated rows;
other columns are dropped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import pick, portions

VOCABULARY = "word_bpe_49k.json"
#: Each Python worker keeps at most twice as many words with their tokens, and as many neighbours.
KNOWN_WORDS = 75_000
KNOWN_PAIRS = 100_000
#: Tokens decoded at a time.
DECODE_TOKENS = 1 << 16
_WHITE = r"\t-\r \x85\xa0  -     　"


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for a tokenizers file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", _WHITE)).findall
        #: The same for lower-case ASCII texts, which are their own normal form.
        self.ascii_words = re.compile(split.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")).findall
        self.letters = _byte_letters()
        self.table = {b: ord(c) for b, c in self.letters.items()}
        ids = {self._atoms(t): i for t, i in model["vocab"].items()}
        self.length = {i: len(t) for t, i in ids.items()}
        parts = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        vocab = model["vocab"]
        #: Of each merged token: its rank and its two parts.
        self.made = {vocab[a + b]: (r, vocab[a], vocab[b]) for r, (a, b) in enumerate(parts)}
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(parts)}
        self.shorter = {i: next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])

    def _atoms(self, token: str) -> str:
        """The letters of a token; the last of a word is another letter, so that the end of a word is part of the match."""
        if not token.endswith(self.end):
            return token
        token = token[: -len(self.end)]
        return token[:-1] + chr(ord(token[-1]) + 0x1000)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two adjacent tokens.

        Merges run by rank. The symbols at the border are the right edge of the left token and the left edge of the
        right one as they grow; a rule that joins two of them runs if it comes before both are used up. Of equal
        ranks the left one runs first.
        """
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            never = len(self.rank)
            edge_l, edge_r = [(left, never)], [(right, never)]
            while edge_l[-1][0] in self.made:
                r, _, b = self.made[edge_l[-1][0]]
                edge_l.append((b, r))
            while edge_r[-1][0] in self.made:
                r, a, _ = self.made[edge_r[-1][0]]
                edge_r.append((a, r))
            found = not any((r := self.rank.get((a, b), -1)) >= 0 and r < used_a and r <= used_b for a, used_a in edge_l for b, used_b in edge_r)
            if len(self.fits) >= KNOWN_PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        s = s[:-1] + chr(ord(s[-1]) + 0x1000)
        n = len(s)
        longest = [-1] * n
        for end, (length, i) in self.automaton.iter(s):
            longest[end - length + 1] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token] if token >= 0 else 0
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
            elif not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_pattern is None or "<|" not in text and not self.special_pattern.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        known = self.known
        words = self.ascii_words(text.lower()) if text.isascii() else self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else self._learn(w) for w in words])

    def _learn(self, word: str) -> bytes:
        """Words that are met again stay; the others go when as many new ones have come."""
        coded = self.older.get(word) or np.array(self.encode_word(word), "<u4").tobytes()
        if len(self.known) >= KNOWN_WORDS:
            self.older = self.known.copy()
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = coded
        return coded

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids, as UTF-8: the tokens with a space between."""
        all_ids = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for i in range(0, len(all_ids), DECODE_TOKENS):
            part = all_ids[i : i + DECODE_TOKENS]
            starts = self.offsets[part]
            lengths = self.offsets[part + 1] - starts
            before = np.cumsum(lengths) - lengths
            out.append(self.blob[np.repeat(starts - before, lengths) + np.arange(lengths.sum())].tobytes())
        return b"".join(out)[:-1]


_loaded: dict[str, WordBpe] = {}


def load(path: str | None = None) -> WordBpe:
    path = vocabulary_path(path)
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encodes each whole text and decodes its ids again.

    Returns id_col, n_tokens long, ids binary (little-endian unsigned 32-bit) and decoded string. It reads each text
    once where it lies, without a shuffle. ``vocabulary``: the path of the tokenizer's file on each machine.
    """
    source = pick(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in portions(batch, "text"):
                ids = [bpe.encode(x.as_py() or "") for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x).decode("utf-8", "replace") for x in ids], pa.string())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")

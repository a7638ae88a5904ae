"""BPE encoding and decoding over a trie of distinct words.

Every BPE encoding of a prefix ends in exactly one token, and the tokens before
it are the encoding of the shorter prefix. So a trie node needs only its last
token: the one suffix of the prefix that is a token and whose pair with the
last token of the node where the suffix starts is stable under the merges.
The distinct new words of a batch are put in sorted order, which is the trie in
depth-first order: a stack holds the nodes of the current path, a word pops to
the prefix it shares with the word before, and each node is computed once.

Words end in a symbol of their own (``x</w>``), so a word's final symbol is a
leaf beside the inner node of the plain symbol.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose encodings a worker holds; beyond it the table starts anew.
CACHED_WORDS = 200_000
#: Token pairs whose stability a worker holds.
CACHED_PAIRS = 200_000
#: Characters of the texts that share a trie and are Python strings at once.
GROUP = 3_000_000
END = "</w>"
#: The pre-tokenizer's pattern, over lower-cased text, for text in ASCII and for any other.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    held, others = set(plain), iter(range(256, 512))
    return [chr(b) if b in held else chr(next(others)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with word ends, as one tokenizers JSON file has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary with </w> word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.split_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.level: dict[int, int] = {}  # of a token: the rank of the merge that makes it, single symbols -1
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            if (a, b) not in self.rank:
                self.rank[a, b], self.joined[a, b] = r, c
                if c not in self.halves:
                    self.halves[c], self.level[c] = (a, b), r
        self.symbols = byte_symbols()
        self.stable: dict[tuple[int, int], bool] = {}
        # Tokens by their symbols; only those that their own merges lead to can occur.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, i in self.vocab.items():
            ends = t.endswith(END) and len(t) > len(END)
            base = t[: -len(END)] if ends else t
            if i in self.halves or len(base) == 1:
                (self.final if ends else self.inner)[base] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.known: dict[str, tuple[int, str, str]] = {}

    def _stable_pair(self, left: int, right: int) -> bool:
        """Whether the text of two tokens is encoded as these two.

        Undoes the later of the two tokens' last merges again and again; at each
        depth the pair that then faces the border must not merge earlier than
        what was undone. Equal ranks merge left before right.
        """
        known = self.stable.get((left, right))
        if known is not None:
            return known
        a, b, ok = left, right, True
        level = self.level
        until_a = until_b = 1 << 60  # ranks of the merges that take the facing tokens away from the border
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                ok = False
                break
            la, lb = level.get(a, -1), level.get(b, -1)
            if la < 0 and lb < 0:
                break
            if la > lb:
                until_a, a = la, self.halves[a][1]
            else:
                until_b, b = lb, self.halves[b][0]
        if len(self.stable) > CACHED_PAIRS:
            self.stable.clear()
        self.stable[left, right] = ok
        return ok

    def _last(self, word: str, end: int, lasts: list[int], table: dict[str, int]) -> int:
        """The length of the last token of word[:end], given the last tokens of the shorter prefixes."""
        for n in range(min(end, self.longest), 0, -1):
            t = table.get(word[end - n : end])
            if t is not None and (n == end or self._stable_pair(lasts[end - n], t)):
                return n
        raise ValueError(f"no encoding of {word[:end]!r}")

    def _encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Encodings of distinct words of byte symbols that come in sorted order."""
        path = ""
        lasts, sizes = [-1], [0]  # per depth: the node's last token and how many symbols it has
        for word in words:
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :], sizes[shared + 1 :]
            for end in range(shared + 1, len(word)):
                n = self._last(word, end, lasts, self.inner)
                lasts.append(self.inner[word[end - n : end]])
                sizes.append(n)
            path = word[:-1]
            n = self._last(word, len(word), lasts, self.final)
            ids, at = [self.final[word[len(word) - n :]]], len(word) - n
            while at:
                ids.append(lasts[at])
                at -= sizes[at]
            yield word, ids[::-1]

    def learn(self, words: Iterable[str]) -> None:
        """Puts the encodings of new words (as text) into the table ``known``."""
        symbols = self.symbols
        by_symbols = {"".join([symbols[b] for b in w.encode("utf-8")]) if not w.isascii() else w.translate(_ASCII_SYMBOLS): w for w in words}
        for mapped, ids in self._encode_sorted(sorted(by_symbols)):
            self.known[by_symbols[mapped]] = (len(ids), " ".join(map(str, ids)), " ".join([self.text[i] for i in ids]))

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens' strings in order, as pre-tokenized."""
        if self.split_at and "<|" in text and len(parts := self.split_at.split(text)) > 1:
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._pieces(p))]
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_PIECES.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return PIECES.findall(text)

    def encode_batch(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """Per text its pieces' (number of tokens, ids, token strings)."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        for t, i in self.special.items():
            self.known[t] = (1, str(i), t)
        at = 0
        while at < len(texts):  # groups of texts of some million characters share a trie
            split, size = [], 0
            while at < len(texts) and (not split or size < GROUP):
                split.append(self.pieces(texts[at]))
                size += len(texts[at])
                at += 1
            new = set().union(*split) - self.known.keys()
            if new:
                self.learn(new)
            for words in split:
                yield list(map(self.known.__getitem__, words))

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces: the file names no decoder."""
        return " ".join([self.text[i] for i in ids if i in self.text])


_ASCII_SYMBOLS = {b: s for b, s in enumerate(byte_symbols()[:128])}
_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One vocabulary and word table per Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _chunks(batch: pa.RecordBatch, col: int, chars: int = GROUP) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a batch, so that few long texts are Python strings at once."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(batch.column(col)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, emit: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(id, n_tokens, ...) per row; ``emit`` names more columns.

    ids: array of token ids; decoded: the decoded text; ids_sha256 and
    decoded_sha256: digests of the ids joined by spaces and of the decoded text.
    Null, empty and blank texts have no tokens. The strings of special tokens in
    a text are those tokens. Repeated rows and null ids are returned as they
    come; extra columns are ignored; an empty table gives an empty result.
    ``path`` must be there on every executor.
    """
    path = path or default_vocabulary()
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                out: dict[str, list] = {k: [] for k in ("n_tokens", *emit)}
                for found in bpe.encode_batch(texts):
                    out["n_tokens"].append(sum([x[0] for x in found]))
                    ids = " ".join([x[1] for x in found])
                    if "ids" in out:
                        out["ids"].append(np.fromstring(ids, dtype=np.int32, sep=" "))
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    if "decoded" in out or "decoded_sha256" in out:
                        text = " ".join([x[2] for x in found])
                        if "decoded" in out:
                            out["decoded"].append(text)
                        if "decoded_sha256" in out:
                            out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                cols = [batch.column(0).slice(first, len(texts)), pa.array(out["n_tokens"], pa.int64()), *[pa.array(out[k], kinds[k][1]) for k in emit]]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", *emit])

    schema = ", ".join(["id long", "n_tokens long", *[f"{k} {kinds[k][0]}" for k in emit]])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded) from token ids; ids that the vocabulary lacks are skipped, null is no ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded string")

"""Token counts with a whole-token shortcut.

Offline, on the driver, every vocabulary string that can be a whole pre-token is encoded alone; those
that give exactly one token are proved whole.  Pre-tokens of a text that are proved whole count one;
only the rest are merged, each distinct one once for a worker's memory.

Words are cut into pre-tokens here only where that is certain to equal the tokenizer's own rules: they
hold no special token string and only characters that a second offline proof has found certain,
one by one.  Any other word goes to the tokenizer as it is.  Texts are read in pieces that end at white
space, which no token spans, so memory stays bounded for very long texts.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as
the tokenizer's default does; repeated rows and ids give one row each; an empty table none.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LIMIT = 2048
PIECE = 1 << 16
MEMO = 1 << 20
#: Fixed values of the vocabulary file's pre-tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: White space at which texts may be cut.
SPACES = " \t\n\r"
WORD = re.compile(f"[^{SPACES}]+").findall
SIGMA = "\u03a3"
#: Pre-tokens up to this length are remembered.
LONGEST_KNOWN = 64


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(spec: str) -> frozenset[str]:
    """Pre-token strings of the vocabulary in ``spec`` (the tokenizer file's text) that encode alone as one token."""
    from tokenizers import Tokenizer

    tok, alphabet = Tokenizer.from_str(spec), _byte_alphabet()
    names = []
    for entry in json.loads(spec)["model"]["vocab"]:
        if entry.endswith(END):
            try:
                names.append(bytes(alphabet[c] for c in entry.removesuffix(END)).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    coded = tok.encode_batch(names, add_special_tokens=False)
    return frozenset(n for n, e in zip(names, coded, strict=True) if n and len(e.ids) == 1)


def _second_of_a_composition() -> frozenset[int]:
    """Characters that a normalisation to composed form may merge into the one before."""
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(int(parts[1], 16))
    return frozenset(found)


def prove_certain_characters(spec: str, top: int = 0x20000) -> str:
    """Characters below ``top`` whose words are cut here exactly as the tokenizer cuts them, as a character class.

    Normalisation and pre-tokenisation look at single characters but for composition and for the lower
    case of a final sigma.  So a character is certain if it can't compose with the one before, the
    tokenizer's normaliser gives the character's lower case, again one character, and the tokenizer's
    pre-tokens of it beside letters, digits, punctuation and itself are those of ``PRE_TOKEN``.
    """
    import regex
    from tokenizers import Tokenizer

    tok, split, second = Tokenizer.from_str(spec), regex.compile(PRE_TOKEN).findall, _second_of_a_composition()
    back = {c: bytes([b]) for c, b in _byte_alphabet().items()}
    good = []
    for c in range(top):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind in ("Cn", "Cs", "Co", "Zs", "Zl", "Zp") and x != " " or unicodedata.combining(x) or c in second or x == SIGMA:
            continue
        low = x.lower()
        if len(low) != 1 or not unicodedata.is_normalized("NFC", x) or (x.isspace() and x not in SPACES):
            continue
        if x not in SPACES and tok.normalizer.normalize_str(x) != low:
            continue
        probe = f"a{x}b1{x}2!{x}?{x}{x}'s"
        mine = split(probe.lower())
        theirs = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(probe))
        if mine == [b"".join(back[ch] for ch in p).decode(errors="replace") for p, _ in theirs]:
            good.append(c)
    ranges, first = [], None
    for i, c in enumerate(good):
        first = c if first is None else first
        if i + 1 == len(good) or good[i + 1] != c + 1:
            ranges.append(f"\\U{first:08x}-\\U{c:08x}")
            first = None
    return f"[{''.join(ranges)}]*"


class Counter:
    """Counts tokens of texts as the tokenizer of ``spec`` does; ``fallback`` counts words that went to it uncut, of ``words``."""

    def __init__(self, spec: str, whole: frozenset[str], certain: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.special = tuple(t["content"] for t in json.loads(spec)["added_tokens"])
        self.split, self.certain = regex.compile(PRE_TOKEN).findall, re.compile(certain).fullmatch
        self.whole = whole
        self.known: dict[str, int] = dict.fromkeys(whole, 1)
        self.fallback = self.words = 0

    def _library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _merged(self, pre_token: str) -> int:
        n = self._library(pre_token)
        if len(pre_token) <= LONGEST_KNOWN:
            if len(self.known) > len(self.whole) + MEMO:
                self.known = dict.fromkeys(self.whole, 1)
            self.known[pre_token] = n
        return n

    def _sure(self, text: str) -> bool:
        return self.certain(text) is not None and not any(s in text for s in self.special)

    def _cut(self, text: str) -> int:
        total, get = 0, self.known.get
        for p in self.split(text.lower()):
            total += get(p) or self._merged(p)
        return total

    def piece(self, text: str) -> int:
        if self._sure(text):
            return self._cut(text)
        # no token or special string spans a space: the sure words are cut together, each other one is the library's
        sure, total = [], 0
        for word in WORD(text):
            self.words += 1
            if self._sure(word):
                sure.append(word)
            else:
                self.fallback += 1
                total += self._library(word)
        return total + self._cut(" ".join(sure))

    def count(self, text: str) -> int:
        total, at = 0, 0
        while len(text) - at > PIECE:
            end = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
            if end <= at:  # a run without white space is one piece
                found = [i for i in (text.find(" ", at + PIECE), text.find("\n", at + PIECE)) if i >= 0]
                end = min(found, default=len(text))
            total += self.piece(text[at:end])
            at = end
        return total + self.piece(text[at:])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    The tokenizer file is read on the driver; it and the proved strings are broadcast, a few MB
    that depend on the vocabulary alone.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec), prove_certain_characters(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*sent.value)
        for b in batches:
            n = pa.array([counter.count(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = text_of("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

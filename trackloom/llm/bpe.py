"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every word is a row of symbols.  A segment tree holds, for each adjacent pair,
its merge rank and position packed in one integer; the root is therefore the
leftmost pair of lowest rank.  A merge changes three leaves at most, each a
logarithmic update, so a word of n symbols costs O(n log n) whatever n is.

The vocabulary file of a public tokenizer is a parameter.  Text preparation
follows the file: added tokens are cut out of the raw text, then NFC, white
space, lower case, and the split pattern.  Texts whose characters are all
below U+0180 take a path of precompiled character classes (there NFC changes
nothing and lower case stays in the range, but for U+0130); other texts use the tokenizer
file's own normaliser and splitter, so that Unicode tables agree.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import table

_INF = 1 << 62


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none is left.

    ``ranks`` has the rank of a pair ``left << 20 | right``, ``merged`` the
    symbol that each rank makes.  ``tree`` is an implicit segment tree whose
    leaf i holds ``rank << bits | i`` for the pair that starts at symbol i.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    bits = n.bit_length()
    size = 1 << (n - 2).bit_length()
    tree = [_INF] * (2 * size)
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = get(left << 20 | right)
        if rank is not None:
            tree[size + i - 1] = rank << bits | i - 1
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    best = tree[1]
    if best == _INF:
        return symbols
    mask = (1 << bits) - 1
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while best != _INF:
        i = best & mask
        j = after[i]
        symbol = symbols[i] = merged[best >> bits]
        symbols[j] = -1
        k = after[i] = after[j]
        value = _INF
        if k < n:
            before[k] = i
            rank = get(symbol << 20 | symbols[k])
            if rank is not None:
                value = rank << bits | i
        changes = [(i, value)]
        if j < n - 1:
            changes.append((j, _INF))
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << 20 | symbol)
            changes.append((h, _INF if rank is None else rank << bits | h))
        for at, value in changes:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
        best = tree[1]
    return [s for s in symbols if s >= 0]


def _low_class(keep) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x180) if keep(unicodedata.category(chr(c))[0]))


_LETTERS, _NUMBERS = _low_class("L".__eq__), _low_class("N".__eq__)
_SPACES = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0"
_LOW_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_HIGH = re.compile("[^\\x00-\\u012f\\u0131-\\u017f]")


#: Fixed values of the file format: the preparation that ``_LOW_SPLIT`` does in one pass, and the model's options.
PREPARED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
UNSUPPORTED = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def check_spec(spec: dict) -> None:
    """Raise for a file that asks for something this encoder does not do."""
    bad = [o for o in UNSUPPORTED if spec["model"].get(o)]
    bad += [f"added token {t['content']}" for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"]]
    if spec["model"].get("type", "BPE") != "BPE" or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
        bad.append("other than byte-level BPE")
    if spec.get("decoder") is not None:
        bad.append("decoder")
    if bad:
        raise ValueError(f"not supported in a vocabulary file: {', '.join(bad)}")


class WordBPE:
    """Encoder and decoder for a byte-level BPE vocabulary in the ``tokenizers`` JSON format.

    Normaliser and splitter are those of the file; texts of low characters take
    a shorter way if the file prepares texts as ``PREPARED`` says.  Files that
    ask for more than this does (``check_spec``) are refused.
    """

    def __init__(self, path: str, cache_words: int = 100_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._mark = os.path.commonprefix(list(self.added))
        self._low_way = (spec["normalizer"], spec["pre_tokenizer"]) == PREPARED
        self._cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        library = Tokenizer.from_file(path)
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        alphabet = byte_alphabet()
        self._inner = [self.vocab.get(c) for c in alphabet]
        self._last = [self.vocab.get(c + self.end) for c in alphabet]
        self._byte = {c: b for b, c in enumerate(alphabet)}
        self._low, self._high = _Cache(self._encode_raw, cache_words), _Cache(self._encode_mapped, cache_words)

    def _encode_bytes(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of a word; symbols without an id drop out."""
        inner = self._inner
        symbols = [inner[b] for b in word]
        symbols[-1] = self._last[word[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return array.array("I", merge_word(symbols, self.ranks, self.merged)).tobytes()

    def _encode_raw(self, word: str) -> bytes:
        return self._encode_bytes(word.encode())

    def _encode_mapped(self, word: str) -> bytes:
        return self._encode_bytes(bytes([self._byte[c] for c in word]))

    def _plain(self, text: str) -> bytes:
        if self._low_way and _HIGH.search(text) is None:
            return b"".join(map(self._low.__getitem__, _LOW_SPLIT.findall(text.lower())))
        words = self._splitter.pre_tokenize_str(self._normalizer.normalize_str(text) if self._normalizer else text)
        return b"".join([self._high[w] for w, _ in words if w])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self._cut is None or self._mark not in text:
            out = self._plain(text)
        else:
            parts, at = [], 0
            for m in self._cut.finditer(text):
                parts += self._plain(text[at : m.start()]), array.array("I", [self.added[m[0]]]).tobytes()
                at = m.end()
            out = b"".join([*parts, self._plain(text[at:])])
        self._low.trim()
        self._high.trim()
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(map(self.token.__getitem__, array.array("I", ids)))


class _Cache(dict):
    """Words already merged, in two generations of at most ``most`` each: those asked for again outlive the older."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


assert sys.byteorder == "little" and array.array("I").itemsize == 4

_READY: dict[str, WordBPE] = {}


def _tokenizer(path: str) -> WordBPE:
    if path not in _READY:
        _READY[path] = WordBPE(path)
    return _READY[path]


def _round_trip(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest() if digest else array.array("I", ids).tolist())
                b.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(a, pa.string() if digest else pa.list_(pa.int64())), "decoded": pa.array(b, pa.string())})

    return run


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row.

    With ``digest`` the last two are SHA-256 in hex, of the ids as
    little-endian 32-bit integers and of the decoded UTF-8.

    Defined cases: null texts count as empty and have no tokens; texts and
    words may be of any length; repeated rows, null ids and empty tables pass
    through; other columns are ignored, whatever their names; a vocabulary
    file that ``check_spec`` refuses raises.
    """
    kind = "string" if digest else "array<long>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_round_trip(path, digest), f"doc_id long, n_tokens long, ids {kind}, decoded string")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary_path(), digest=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})

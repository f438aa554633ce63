"""BPE encoding by backtracking over Aho-Corasick matches; decoding by an offset table.

Encoding a word: all vocabulary entries in it come from one Aho-Corasick scan.
From the left, the longest entry is tried whose pair with the entry before it
is compatible, meaning that BPE on the two together would give just those two;
if none fits, the last entry is taken back and its place marked as dead, so
every position is settled once and the time is linear.  A sequence of
compatible neighbours is the BPE result, as merges only ever act on
neighbours.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.kernels import string_buffers

WORD_CACHE = 500_000  # distinct words that a worker remembers

#: White space as the tokenizer's \s knows it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Code points that the regex module takes for letters or numbers
#: by a newer Unicode than the tokenizer's, which takes them for neither.
NEWER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"""

#: Capitals newer than Python's tables, and their small letters.
NEWER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _ranges(text: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    ends = [[chr(int(x, 16)) for x in r.split("-")] for r in text.split()]
    return "".join(regex.escape(e[0]) + ("-" + regex.escape(e[1]) if len(e) > 1 else "") for e in ends)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    return [letters.get(b) or chr(256 + k) for b, k in sorted([(b, 0) for b in plain] + [(b, k) for k, b in enumerate(rest)])]


class BacktrackingBpe:
    """Tables of one vocabulary file, and encoding of texts and decoding of ids."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self._check(spec)
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words = regex.compile(pattern).findall
        newer = _ranges(NEWER)
        self.odd = regex.compile("[" + newer + "".join(map(chr, NEWER_CAPITALS)) + "]").search
        old = {f"[\\p{{{c}}}]": f"[\\p{{{c}}}--[{newer}]]" for c in "LN"}
        last = f"[^{SPACE}\\p{{L}}\\p{{N}}]"
        for plain, less in {**old, last: f"[{last}||[{newer}]]"}.items():
            pattern = pattern.replace(plain, less)
        self.odd_words = regex.compile(pattern, regex.V1).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_packed = {k: np.array([i], dtype=np.int32).tobytes() for k, i in special.items()}
        self.letters = dict(enumerate(_byte_letters()))
        self.vocab = vocab

        # merge tables; a merged entry's rank orders it against all others
        pairs: dict[tuple[int, int], int] = {}
        size = max([*vocab.values(), *special.values()]) + 1
        split = [(i, i) for i in range(size)]
        rank = [-1] * size
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            whole = vocab[left + right]
            pairs.setdefault((vocab[left], vocab[right]), r)
            if rank[whole] < 0:
                rank[whole], split[whole] = r, (vocab[left], vocab[right])
        self.pairs, self.split, self.rank = pairs, split, rank
        self.compatible_seen: dict[tuple[int, int], bool] = {}

        # one character stands for the end of a word, so suffixed entries are strings like others
        self.end = "\x00" if self.suffix else ""
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            key = text[: -len(self.suffix)] + self.end if self.suffix and text.endswith(self.suffix) else text
            # an entry made by no merge is reached only as a single symbol
            if rank[i] >= 0 or len(key.rstrip("\x00")) == 1:
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.cache: dict[str, bytes] = {}

        names = [""] * size
        for text, i in [*vocab.items(), *special.items()]:
            names[i] = text
        coded = [(x + " ").encode() for x in names]
        self.blob = np.frombuffer(b"".join(coded), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)

    @staticmethod
    def _check(spec: dict) -> None:
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["byte_fallback"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("this kind of vocabulary file is not supported")

    def compatible(self, left: int, right: int) -> bool:
        """True if BPE keeps ``left`` and ``right`` apart when they stand alone together.

        Undo the later of the merges that made the entries at the boundary,
        step by step.  Should a pair across the boundary have a merge that
        would come before the merge just undone, BPE would have taken it.
        """
        known = self.compatible_seen.get((left, right))
        if known is not None:
            return known
        key, rank, split = (left, right), self.rank, self.split
        limit, early = len(self.pairs) + 1, True  # the merge last undone, and whether one of its rank would come first
        good = True
        while True:
            merge = self.pairs.get((left, right))
            # of equal ranks the pair further left is merged first
            if merge is not None and (merge < limit or (merge == limit and early)):
                good = False
                break
            if rank[left] < 0 and rank[right] < 0:
                break
            if rank[left] > rank[right]:
                limit, early = rank[left], False
                left = split[left][1]
            else:
                limit, early = rank[right], True
                right = split[right][0]
        if len(self.compatible_seen) > 2_000_000:
            self.compatible_seen.clear()
        self.compatible_seen[key] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        text = word + self.end
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (length, i) in self.automaton.iter(text):
            starts[last + 1 - length].append((length, i))
        taken: list[tuple[int, int]] = []  # (start, index into the start's matches)
        dead = bytearray(n + 1)
        at, nth = 0, len(starts[0]) - 1  # matches at a start come with growing length
        while at < n:
            while nth >= 0:
                length, i = starts[at][nth]
                # a symbol and the end of its word are never apart
                if not dead[at + length] and not (self.end and at + length == n - 1):
                    if not taken or self.compatible(starts[taken[-1][0]][taken[-1][1]][1], i):
                        break
                nth -= 1
            if nth >= 0:
                taken.append((at, nth))
                at += length
                nth = len(starts[at]) - 1 if at < n else 0
            else:
                if not taken:
                    raise ValueError("no sequence of entries spells this word")
                dead[at] = 1
                at, nth = taken.pop()
                nth -= 1
        return [starts[a][k][1] for a, k in taken]

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # lower-casing by character: no rule for a sigma that ends a word
        text = "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()
        return text.translate(NEWER_CAPITALS) if self._has_odd(text) else text

    def _has_odd(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.odd(text))

    def _new_word(self, word: str) -> bytes:
        ids = self.encode_word("".join(map(self.letters.__getitem__, word.encode())))
        packed = array("i", ids).tobytes()
        if len(word) < 64:
            if len(self.cache) >= WORD_CACHE:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        text = self.normalize(text)
        known, new = self.cache.get, self._new_word
        words = self.words if text.isascii() or not self._has_odd(text) else self.odd_words
        return b"".join([known(word) or new(word) for word in words(text)])

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers; the strings of special entries become their ids."""
        if not any(x in text for x in self.special_packed):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self.special_packed[x] if x in self.special_packed else self._plain(x) for x in parts if x)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The entries' texts with a space between them, gathered through the offset table; other numbers are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        if not len(ids):
            return b""
        start, end = self.offsets[ids], self.offsets[ids + 1]
        length = end - start
        place = np.cumsum(length) - length
        index = np.arange(int(length.sum())) + np.repeat(start - place, length)
        return self.blob[index].tobytes()[:-1]


_loaded: dict[str, BacktrackingBpe] = {}


def load(raw: bytes) -> BacktrackingBpe:
    """Tables for the bytes of a vocabulary file, built once a process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = BacktrackingBpe(json.loads(raw))
    return _loaded[key]


def vocabulary(spark, path: str):
    """Read the file on the driver and broadcast its bytes (about 2 MB, whatever the corpus)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of values in each."""
    if pa.types.is_list(column.type):
        at = column.value_lengths().fill_null(0).to_numpy()
    else:
        at = np.diff(string_buffers(column)[1])
    ends = np.cumsum(at)
    i = 0
    while i < len(column):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield i, j
        i = j


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "token_ids") -> DataFrame:
    """The ``keep`` columns and ``token_ids`` array<int> of every whole text.

    A null text is an empty one and has no ids, as has a text of white space
    only.  Repeated rows are encoded each.  Columns not in ``keep`` are not
    read; ``ids_col`` must not be among them.  An empty table gives an empty
    result.
    """
    if ids_col in keep:
        raise ValueError(f"{ids_col} is both kept and made")
    box = vocabulary(docs.sparkSession, path)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(box.value)
        for batch in batches:
            text = batch.column(len(keep))
            for i, j in _pieces(text, 1 << 20):
                ids = [bpe.encode_packed(x) if x else b"" for x in text.slice(i, j - i).to_pylist()]
                at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                    names=[*keep, ids_col],
                )

    schema = source.drop("__text").schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id", "token_ids"), text_col: str = "decoded") -> DataFrame:
    """The ``keep`` columns and the text of every array of ids; a null array gives an empty text.

    Ids that the vocabulary does not have, negative ones too, and nulls within
    an array are left out, as the library leaves them out.
    """
    if text_col in keep:
        raise ValueError(f"{text_col} is both kept and made")
    box = vocabulary(tokens.sparkSession, path)
    source = tokens.select(*keep, F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(box.value)
        for batch in batches:
            lists = batch.column(len(keep))
            for i, j in _pieces(lists, 1 << 18):
                part = lists.slice(i, j - i)
                at = np.concatenate(([0], np.cumsum(part.value_lengths().fill_null(0).to_numpy())))
                flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = [bpe.decode(flat[at[k] : at[k + 1]]).decode() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(texts, type=pa.string())], names=[*keep, text_col]
                )

    schema = source.drop("__ids").schema.add(text_col, T.StringType())
    return source.mapInArrow(run, schema)

"""BPE encoding by tree concatenation, and decoding, with a public tokenizer file.

A text longer than ``LEAF`` characters is not split first: its halves are encoded on their own (in parallel threads
for the top of the tree), and a window around the join grows until both sides agree: until it begins and ends at a
token boundary that every context has, which the old and the new encodings then share. Such a boundary is a
white-space character behind one that is not. What holds none ("long unsplit text": scripts without spaces, emoji,
encoded data) is cut as the tokenizer file's own pre-tokenizer does, and a pre-token longer than ``PIECE`` bytes is
encoded as a tree of its own: a growing window of tokens around the join is encoded again until its first token equals
the one on the left and its last the one on the right. A token sequence whose every adjacent pair is left alone by BPE
is *the* BPE encoding, so agreement on both sides makes the result exact. Leaves are encoded by an engine built from the
same file, or by the tokenizers library where they hold characters whose classes the engine may see otherwise.

Cases: a null text is an empty one (no ids, empty decoded text); special-token strings in a text become
their ids, as the library does by default; repeated and tied rows are encoded alike; an empty table gives
an empty table; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintlake.llm.storage import bounded

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leaves of a text's tree, in characters, and of a pre-token's tree, in bytes: at most.
LEAF = 1 << 12
PIECE = 1 << 9
#: First reach of a window to either side of a join, in characters.
REACH = 64
#: A text whose halves are encoded in threads, in characters, at least.
PARALLEL = 1 << 16
#: Characters for which the fast engine's Unicode tables are proven equal to the library's; others use the library.
_PLAIN = re.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]")
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")
_THREADS = ThreadPoolExecutor(2)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes exactly as the tokenizers library does with the file ``path``; without ``specials``, as it does
    with the strings of special tokens taken for plain text."""

    def __init__(self, path: str, specials: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {b: i for i, b in as_bytes.items()}
        pre = spec.get("pre_tokenizer") or {}
        self.fast = (
            spec["model"]["type"] == "BPE"
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.engine = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.fast else None
        self.library.encode_special_tokens = not specials
        self.special = special if specials else {}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*as_bytes, *special.values()]) + 1
        self.bytes_of = [as_bytes.get(i, b"") for i in range(size)]
        for text, i in special.items():
            self.bytes_of[i] = text.encode()
        self.decimal = [str(i) for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes_of])
        #: Joins of halves of texts and of pre-tokens.
        self.joins = [0, 0]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as uint32."""
        if not text:
            return np.zeros(0, np.uint32)
        if not self.fast:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if self._special is None or not any(s in text for s in self.special):
            return self.tree(text)
        parts = [np.array([self.special[p]], np.uint32) if p in self.special else self.tree(p) for p in self._special.split(text) if p]
        return np.concatenate(parts)

    def _leaf(self, text: str) -> np.ndarray:
        if _PLAIN.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.engine.encode_to_numpy(text, disallowed_special=())

    def tree(self, text: str, threads: bool = True) -> np.ndarray:
        """The ids of a text without special tokens: halves apart, then joined."""
        if len(text) <= LEAF:
            return self._leaf(text)
        if _CUT.search(text) is None:
            return self._unsplit(text)
        halves = text[: len(text) // 2], text[len(text) // 2 :]
        below = functools.partial(self.tree, threads=False)  # a thread of the pool starts no others
        left, right = _THREADS.map(below, halves) if threads and len(text) > PARALLEL else map(below, halves)
        return self.join(*halves, left, right)

    def join(self, a: str, b: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a + b from those of a and of b, which are encoded again only around the join."""
        self.joins[0] += 1
        reach = REACH
        begin, end = None, None
        while begin is None or end is None:
            if begin is None:
                found = [m.start() for m in _CUT.finditer(a, max(0, len(a) - reach))]
                begin = found[-1] if found else 0 if reach >= len(a) else None
            if end is None:
                m = _CUT.search(b, 0, reach)
                end = m.start() if m else len(b) if reach >= len(b) else None
            reach *= 2
        again = self._window(a[begin:] + b[:end])
        gone, come = len(a[begin:].encode()), len(b[:end].encode())  # bytes, and so at least as many as tokens
        head = len(left) - int(np.searchsorted(np.cumsum(self.lengths[left[-gone:]][::-1]), gone)) - 1 if gone else len(left)
        tail = int(np.searchsorted(np.cumsum(self.lengths[right[:come]]), come)) + 1 if come else 0
        return np.concatenate([left[:head], again, right[tail:]])

    def _window(self, text: str) -> np.ndarray:
        return self._leaf(text) if len(text) <= LEAF else self._unsplit(text)

    def _unsplit(self, text: str) -> np.ndarray:
        """The ids of a text without a place where every context cuts: by the file's own pre-tokens."""
        ids: list[int] = []
        for _, (begin, end) in self.library.pre_tokenizer.pre_tokenize_str(text):
            ids += self.piece_tree(text[begin:end].encode())
        return np.asarray(ids, np.uint32)

    def piece_tree(self, data: bytes) -> list[int]:
        """The ids of one pre-token: halves apart, then joined."""
        if len(data) <= PIECE:
            return self.engine._encode_single_piece(data)
        middle = len(data) // 2
        return self.join_tokens(self.piece_tree(data[:middle]), self.piece_tree(data[middle:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """One encoding from two: encode a growing window around the join until both sides agree."""
        self.joins[1] += 1
        reach = 4
        while True:
            a, b = left[-reach:], right[:reach]
            again = self.engine._encode_single_piece(b"".join(self.bytes_of[i] for i in a + b))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            reach *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; bytes that are no text become U+FFFD, as in the library."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids.tolist()])
        try:
            data.decode("utf-8")
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>`` and ``decoded`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t or "") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[id_col], pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([coder.decode(i).decode() for i in ids], pa.string())], [id_col, "ids", "decoded"])

    source = bounded(df).select(F.col(id_col), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"{id_col} {source.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_texts``, but digests in place of ids and text: n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        decimal = coder.decimal
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"]:
                ids = coder.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = bounded(df).select(F.col(id_col), F.col(text_col).alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

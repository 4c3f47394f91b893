"""BPE encoding and decoding with an index of pair occurrences.

A task takes a block of texts, normalises them and splits them into pre-tokens. Pre-tokens not met
before are encoded together: their symbols lie in one linked list, every adjacent pair is mapped to
all its positions, and the pairs that occur and have a rank (the active ranks) are applied in
ascending order. A merge touches the lists of the pairs to its left and right only. Since a merge can
only create pairs with a later rank or a smaller one that did not occur, ranks wait in a heap; a rank
that becomes active again below the current one is taken up next, and per pre-token the order of
merges is that of the usual greedy algorithm.

Decoding starts from the ids of a block alone: each id's symbol is looked up in the vocabulary and the
symbols of a text are joined.

The vocabulary is read from a file on each task's machine, named by a parameter. Normaliser,
pre-tokenizer and decoder are those of ``COMPONENTS``; a file that names others is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import blocks, bound_batches, documents, query

DIGEST_BLOCK_BYTES, ENCODE_BLOCK_BYTES = 4 << 20, 1 << 20
#: Texts encoded together. Where ids and texts are returned, not their digests, results take memory too.
KNOWN_WORDS = 150_000
#: Encoded pre-tokens a task remembers from block to block; beyond it the memory starts anew.

# The pre-tokenizer's pattern and the white space of the normaliser.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACES = re.compile("[\x1c-\x1f]")
#: str.split() takes these for white space as well.
# The components of the file that this module follows.
COMPONENTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PIECES.pattern}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
# What the tokenizer's Unicode version 16 has and Python's 15.1 has not. Other code
# points that Python does not know are no letters or numbers, whatever the pattern library knows.
SINCE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F),
    (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF),
    (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x18CFF, 0x18CFF), (0x1CC00, 0x1CEBF), (0x1E5D0, 0x1E5FF),
)
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LATER_LOWER |= {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}  # its case mapping is of version 17
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
HAS_LATER_UPPER = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")


def unknown(char: str) -> bool:
    """Not assigned in the tokenizer's Unicode version."""
    return unicodedata.category(char) == "Cn" and not any(a <= ord(char) <= b for a, b in SINCE_16)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, free = [], 256
    for value in range(256):
        table.append(chr(value) if value in shown else chr(free))
        free += value not in shown
    return table


class PairIndex:
    """Symbols of many pre-tokens in one linked list, and the positions of each ranked pair."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]) -> None:
        """``ranks``: pair of ids -> (rank, id of the merged symbol). A pair is held as one number."""
        self.wide = 1 + max((max(a, b, merged) for (a, b), (_, merged) in ranks.items()), default=0)
        self.rank_of = {a * self.wide + b: rank for (a, b), (rank, _) in ranks.items()}
        self.merge_of = {rank: (a, b, merged) for (a, b), (rank, merged) in ranks.items()}

    def occurrences(self, symbols: np.ndarray, after: np.ndarray) -> dict[int, list[int]]:
        """Positions of the left symbol of every ranked pair, ascending."""
        lefts = np.flatnonzero(after >= 0)
        pairs = symbols[lefts] * self.wide + symbols[lefts + 1]
        order = np.argsort(pairs, kind="stable")
        keys, starts = np.unique(pairs[order], return_index=True)
        places, bounds = lefts[order].tolist(), [*starts.tolist(), len(order)]
        return {key: places[bounds[n] : bounds[n + 1]] for n, key in enumerate(keys.tolist()) if key in self.rank_of}

    def encode(self, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of ``lengths`` symbols, one behind the other in ``first``; their ids after
        all merges and the number of each one's."""
        ends = np.cumsum(lengths)
        filled = lengths > 0
        after_all, before_all = np.arange(1, len(first) + 1), np.arange(-1, len(first) - 1)
        after_all[ends[filled] - 1] = -1
        before_all[(ends - lengths)[filled]] = -1
        rank_of, merge_of, wide = self.rank_of, self.merge_of, self.wide
        index = self.occurrences(first, after_all)
        symbols, after, before = first.tolist(), after_all.tolist(), before_all.tolist()
        del after_all, before_all
        active = [rank_of[pair] for pair in index]
        heapq.heapify(active)
        while active:
            left, right, merged = merge_of[heapq.heappop(active)]
            places = index.pop(left * wide + right, None)
            if places is None:
                continue
            places.sort()  # overlapping places, as in "aaa", are taken from the left
            from_merged = merged * wide
            for at in places:
                if symbols[at] != left:
                    continue
                nxt = after[at]
                if nxt < 0 or symbols[nxt] != right:
                    continue
                symbols[at], symbols[nxt] = merged, -1
                far = after[at] = after[nxt]
                if far >= 0:
                    before[far] = at
                    new = from_merged + symbols[far]
                    if new in rank_of:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(active, rank_of[new])
                near = before[at]
                if near >= 0:
                    new = symbols[near] * wide + merged
                    if new in rank_of:
                        if new in index:
                            index[new].append(near)
                        else:
                            index[new] = [near]
                            heapq.heappush(active, rank_of[new])
        merged_all = np.array(symbols, dtype=np.int64)
        left_over = merged_all >= 0
        return merged_all[left_over], counts_of(left_over, ends)


def counts_of(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of ``marks`` are true in each run; ``ends`` are the runs' ends."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[np.concatenate([[0], ends])])


def differing(given: dict) -> list[str]:
    """Names of the components of a tokenizer file that differ from those this module follows."""
    names = [name for name, wanted in COMPONENTS.items() if given.get(name) != wanted]
    names += [f"model.{name}" for name, wanted in MODEL.items() if (given["model"].get(name) or None) != (wanted or None)]
    return names + [f"added token {t['content']}" for t in given["added_tokens"] if any(t.get(k, False) != v for k, v in ADDED.items())]


class WordBpe:
    """The file's tokenizer: added tokens, normaliser, pre-tokenizer, ranked merges, decoder. A file
    with other components than ``COMPONENTS`` is a ValueError."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        if others := differing(given):
            raise ValueError(f"{path} names components that are not implemented: {', '.join(others)}")
        model = given["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            ranks[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.index = PairIndex(ranks)
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        names = {i: name for name, i in (self.vocab | self.added).items()}
        self.symbols = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        end = model.get("end_of_word_suffix") or ""
        self.inner_ids, self.last_ids = (np.array([self.vocab.get(name + tail, -1) for name in byte_symbols()]) for tail in ("", end))
        self.known: dict[str, bytes] = {name: struct.pack("<I", i) for name, i in self.added.items()}
        self.fixed = len(self.known)

    def chunks(self, text: str) -> list[str]:
        """Runs between white space of the normalised text, and added tokens."""
        if self.added_at is None or "<|" not in text:
            return self._chunks(text)
        out = []
        for part in self.added_at.split(text):
            out += [part] if part in self.added else self._chunks(part)
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Letter by letter: lower() alone would give a final sigma.
            text = "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()
            if HAS_LATER_UPPER.search(text):
                text = text.translate(LATER_LOWER)
        else:
            text = text.lower()
        if NOT_SPACES.search(text):
            return [part for part in SPACES.split(text) if part]
        return text.split()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. A piece has at least one byte; bytes without a symbol are left out."""
        raw = [piece.encode() for piece in pieces]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        symbols = self.inner_ids[data]
        symbols[ends - 1] = self.last_ids[data[ends - 1]]
        has = symbols >= 0
        ids, counts = self.index.encode(symbols[has], counts_of(has, ends))
        flat = ids.astype("<u4").tobytes()
        bounds = [0, *(4 * np.cumsum(counts)).tolist()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    @staticmethod
    def _pieces(chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]
        if chunk.isascii() or not any(map(unknown, chunk)):
            return PIECES.findall(chunk)
        # The pattern library may know newer letters than the tokenizer's Unicode version has.
        masked = "".join("\uffff" if unknown(c) else c for c in chunk)
        return [chunk[m.start() : m.end()] for m in PIECES.finditer(masked)]

    def learn(self, new: list[str]) -> None:
        """Encode chunks that are not known yet, all together."""
        pieces = [self._pieces(chunk) for chunk in new]
        distinct = list(dict.fromkeys(chain.from_iterable(pieces)))
        encoded = dict(zip(distinct, self._encoded(distinct), strict=True))
        for chunk, part in zip(new, pieces, strict=True):
            self.known[chunk] = b"".join([encoded[piece] for piece in part])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each text, and the text that they decode to."""
        ids = self.encode_ids(texts)
        return list(zip(ids, self.decode_lists(id_lists(ids)).to_pylist(), strict=True))

    def encode_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Chunks that occur once in the
        texts are forgotten afterwards."""
        chunked = [self.chunks(text) for text in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        counts = Counter(chain.from_iterable(chunked))
        new = [chunk for chunk in counts if chunk not in self.known]
        self.learn(new)
        out = [b"".join([self.known[chunk] for chunk in chunks]) for chunks in chunked]
        for chunk in new:
            if counts[chunk] == 1:
                del self.known[chunk]
        return out

    def forget(self) -> None:
        self.known = dict(list(self.known.items())[: self.fixed])

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The decoded text of each list of ids. The file names no decoder: symbols, one blank between
        them. An empty list gives an empty text, an id that the vocabulary has not an IndexError."""
        symbols = pa.compute.take(self.symbols, lists.values)
        if symbols.null_count:
            raise IndexError("an id is not in the vocabulary")
        return pa.compute.binary_join(pa.ListArray.from_arrays(lists.offsets, symbols), pa.scalar(" ", pa.large_string()))

    def decode(self, ids: bytes) -> str:
        """The decoded text of one text's ids, little-endian unsigned 32-bit integers."""
        return self.decode_lists(id_lists([ids]))[0].as_py()


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Arrow lists of the ids of each text."""
    ends = np.cumsum([0] + [len(part) // 4 for part in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id, ``ids``
    and ``decoded``. A null or empty text has no ids and an empty decoded text."""
    named = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(named)
        for block in blocks(batches, "text", ENCODE_BLOCK_BYTES):
            ids = id_lists(model.encode_ids(block.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([block.column(0), ids, model.decode_lists(ids).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return _plain(docs).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256. A null or empty text has no tokens; repeated rows are answered each;
    an empty table gives no rows."""
    named = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(named)
        for block in blocks(batches, "text", DIGEST_BLOCK_BYTES):
            ids = model.encode_ids(block.column(1).to_pylist())
            decoded = model.decode_lists(id_lists(ids)).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array([len(part) // 4 for part in ids], pa.int64()),
                    pa.array([hashlib.sha256(part).hexdigest() for part in ids]),
                    pa.array([hashlib.sha256(text.as_buffer()).hexdigest() for text in decoded]),
                ],
                schema=schema,
            )

    return _plain(docs).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))

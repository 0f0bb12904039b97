"""BPE encoding and decoding with a contiguous rank array.

A short word keeps the parts between its boundaries in one array and, beside
each, the rank of the pair that starts there.  The lowest rank is found by a
scan, its right boundary deleted and the two neighbouring ranks refreshed, until
no pair has a rank.  For words of a few bytes that is faster than a heap, and as
the arrays are contiguous, all new words of one length go through the same scans
together, a row each.  Words of over LONG_SCAN bytes, for which repeated scans take
the square of their length, keep linked neighbours and a heap of ranks instead.

Results equal those of the ``tokenizers`` library for byte-level BPE files
without normaliser (special tokens found in a text become their own id).

Rows: null text counts as empty and gives no ids; texts of any length are read
whole, each by one task; of pairs of one rank the first is merged; repeated rows
give repeated rows; an empty table gives an empty table; other columns are ignored, whatever
their names.  Text that isn't valid UTF-8 can't occur in a Spark string.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The byte-level pre-tokenizer's pattern.  White space is spelled out as the Unicode property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Pieces and words kept in a worker's caches before they start anew.
CACHE_PIECES, CACHE_WORDS = 300_000, 200_000
#: Longer words skip the caches; longer ones still are merged by a heap.
LONG_WORD, LONG_SCAN = 48, 256
NO_RANK = 1 << 30


def byte_letters() -> list[str]:
    """The printable stand-in of each byte, as byte-level BPE files write them."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ranks, ids and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(back[c] for c in s)
        ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = [tuple(map(raw, p if isinstance(p, list) else p.split(" "))) for p in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: token for token, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = np.append(keys[order], np.int64((1 << 63) - 1)), np.append(order, NO_RANK)
        #: Id of the token that the merge of a rank makes.
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NO_RANK where there is none."""
        want = left << 32 | right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.rank_of_key[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word; words of one length are merged side by side, a row each."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, members in by_length.items():
            if length > LONG_SCAN:
                for i in members:
                    out[i] = self._heap(words[i])
                continue
            raw = np.frombuffer(b"".join([words[i] for i in members]), np.uint8).reshape(-1, length)
            self._rows(np.array(members), self.of_byte[raw], out)
        return out

    def _heap(self, word: bytes) -> list[int]:
        """The ids of one word; each merge unlinks a part and puts its neighbours' new ranks on the heap."""
        first = self.of_byte[np.frombuffer(word, np.uint8)]
        parts, n = first.tolist(), len(word)
        near = [*self.ranks(first[:-1], first[1:]).tolist(), NO_RANK]
        before, behind, made = list(range(-1, n - 1)), list(range(1, n + 1)), self.made.tolist()
        heap = [(rank, i) for i, rank in enumerate(near) if rank != NO_RANK]
        heapify(heap)
        rank_of = self.rank_of
        while heap:
            rank, i = heappop(heap)
            if near[i] != rank:  # the part has gone or changed since
                continue
            j = behind[i]
            parts[i], parts[j], near[j] = made[rank], -1, NO_RANK
            behind[i] = k = behind[j]
            near[i] = rank_of.get(parts[i] << 32 | parts[k], NO_RANK) if k < n else NO_RANK
            if k < n:
                before[k] = i
                if near[i] != NO_RANK:
                    heappush(heap, (near[i], i))
            h = before[i]
            if h >= 0:
                near[h] = rank_of.get(parts[h] << 32 | parts[i], NO_RANK)
                if near[h] != NO_RANK:
                    heappush(heap, (near[h], h))
        return [p for p in parts if p >= 0]

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.rank_of_key.tolist()))

    def _rows(self, at: np.ndarray, parts: np.ndarray, out: list[list[int]]) -> None:
        """parts: what stands between two boundaries of a row; near: the rank of each part with the next."""
        near = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(at):
            if near.shape[1]:
                low = near.argmin(axis=1)
                rank = near[np.arange(len(at)), low]
                done = rank == NO_RANK
            else:
                done = np.ones(len(at), bool)
            if done.any():
                for i, ids in zip(at[done].tolist(), parts[done].tolist()):
                    out[i] = ids
                at, parts, near = at[~done], parts[~done], near[~done]
                if not len(at):
                    return
                low, rank = low[~done], rank[~done]
            rows = np.arange(len(at))
            parts[rows, low] = self.made[rank]
            # delete the boundary between low and low + 1, and the rank that stood beside it
            keep = np.ones(parts.shape, bool)
            keep[rows, low + 1] = False
            parts = parts[keep].reshape(len(at), -1)
            keep = np.ones(near.shape, bool)
            keep[rows, low] = False
            near = near[keep].reshape(len(at), -1)
            # refresh the neighbours
            has = low > 0
            near[rows[has], low[has] - 1] = self.ranks(parts[rows[has], low[has] - 1], parts[rows[has], low[has]])
            has = low < near.shape[1]
            near[rows[has], low[has]] = self.ranks(parts[rows[has], low[has]], parts[rows[has], low[has] + 1])


class Codec:
    """Encodes texts to ids and back; keeps the words and pieces it has met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN)
        self.unsafe = re.compile("[\\s\x85] | [\\s\x85]")  # Python's white space, a superset of SPACE
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        #: piece: (bytes of its ids, ids as text); of strings only, so that the garbage collector has nothing to walk
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self._special_pieces()

    def _special_pieces(self) -> None:
        self.pieces = {s: (s.encode(), str(i)) for s, i in self.vocabulary.special.items()}

    def split(self, text: str) -> list[str]:
        """Pieces of ``text`` that are pre-tokenized each by itself.

        A single space between two visible characters always begins a token, so
        texts are cut there.  Texts with white space beside a space go in one piece.
        """
        parts = self.special.split(text) if self.special and any(s in text for s in self.vocabulary.special) else [text]
        out: list[str] = []
        for part in parts:
            if not part:
                continue
            if part in self.vocabulary.special or part[0] == " " or part[-1] == " " or self.unsafe.search(part):
                out.append(part)
            else:
                head, *rest = part.split(" ")
                out.append(head)
                out += [" " + x for x in rest]
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, str]]:
        """What the caches have of ``pieces``, and the rest by merging; caches are emptied when full."""
        if len(self.pieces) > CACHE_PIECES:
            self._special_pieces()
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [p for p in pieces if p not in self.pieces]
        cut = [self.words.findall(p) for p in new]
        unknown = list({w for ws in cut for w in ws if w not in self.known})
        token, found = self.vocabulary.bytes, {}
        for w, ids in zip(unknown, self.vocabulary.merge([w.encode() for w in unknown])):
            found[w] = (b"".join([token[i] for i in ids]), ",".join(map(str, ids)))
        known = self.known
        known |= {w: x for w, x in found.items() if len(w) <= LONG_WORD}
        long, learnt = {}, self.pieces
        for p, ws in zip(new, cut):
            if len(ws) == 1:
                x = known.get(p) or found[p]
            else:
                parts = [known.get(w) or found[w] for w in ws]
                x = (b"".join([y[0] for y in parts]), ",".join([y[1] for y in parts]))
            (learnt if len(p) <= LONG_WORD else long)[p] = x
        return long

    def encoded(self, texts: list[str]):
        """For each text the list of its pieces as learn() has them."""
        for start in range(0, len(texts), 256):
            split = [self.split(x) for x in texts[start : start + 256]]
            long = self.learn({p for ps in split for p in ps})
            short = self.pieces
            for ps in split:
                yield [long[p] if p in long else short[p] for p in ps] if long else [short[p] for p in ps]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for _, written in ps for i in written.split(",")] for ps in self.encoded(texts)]

    def encode(self, text: str) -> list[int]:
        return self.ids([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Ids back to text; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.vocabulary.bytes[i] for i in ids]).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the token ids of every text of ``docs``."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            ids = codec.ids([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts of every list of ids."""
    schema = T.StructType([T.StructField(key, tokens.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return tokens.select(key, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): one pass that encodes every whole text and decodes the ids."""
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches):
        codec = Codec(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for parts in codec.encoded([x or "" for x in batch.column(1).to_pylist()]):
                written = ",".join([p[1] for p in parts])
                counts.append(written.count(",") + bool(written))
                encoded.append(sha(written.encode()))
                decoded.append(sha(b"".join([p[0] for p in parts]).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)

"""Byte-level BPE as a deterministic automaton over tokens.

The merges of a public vocabulary are compiled one after the other. At first one state loops over all bytes. The merge (u, v) -> w is a gadget: the
state after u loses its transition v; wherever u leads, w leads too, and into the state that v led to at that moment. Then the automaton accepts of all token sequences
exactly those that BPE produces. The state after a token depends on that token alone, and what a merge changes is one transition
and one new state, so the automaton is held as the list of its gadgets: ``left``, ``right`` and ``rank`` of each token and the rank at which a pair was cut. The
row of a state in the transition table is filled as it is used.

A word is encoded by walking its bytes: each prefix has exactly one accepted path, so one table of last tokens is enough. Decoding puts out
the bytes that the arcs are labelled with."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import ship

#: Where the public tokenizers lie; the files are read there and never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern that cuts text into words before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words kept per worker; beyond it the store starts anew. It saves work and changes no result.
KEPT_WORDS = 250_000
#: Longer words are encoded anew each time instead of being kept.
KEPT_LENGTH = 32


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    """``labels``: bytes of each token id; ``merges``: pairs of ids with the id they make, in order of application."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.ids = {b: i for i, b in labels.items()}
        n = max(labels, default=0) + 1
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[int, int] = {}
        self.width = n
        for k, (u, v, w) in enumerate(merges):
            if self.rank[w] >= 0:
                continue  # a second way to the same token: only the first builds it
            self.left[w], self.right[w], self.rank[w] = u, v, k
            self.cut[u * n + v] = k
        # A token lives if its right part could follow its left part when its merge came; the others never occur.
        self.lives = [r < 0 for r in self.rank]
        for u, v, w in merges:
            if (self.left[w], self.right[w]) == (u, v):
                self.lives[w] = self.lives[u] and self.lives[v] and self.leads(u, v, self.rank[w])
        self.table: dict[int, bool] = {}
        # Tokens by their first bytes: every prefix of a token, with the token's id if it is one.
        self.prefixes: dict[bytes, int] = {}
        for b, i in self.ids.items():
            for j in range(1, len(b)):
                self.prefixes.setdefault(b[:j], -1)
            self.prefixes[b] = i
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str = VOCABULARY) -> MergeAutomaton:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = byte_letters()
        made = {b for pair in model["merges"] for b in ("".join(pair.split(" ") if isinstance(pair, str) else pair),)}
        labels = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t in made or len(t) == 1 and t in letters}
        ids = {b: i for i, b in labels.items()}
        code = lambda t: ids[bytes(letters[c] for c in t)]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        return cls(labels, [(code(a), code(b), code(a + b)) for a, b in pairs])

    def leads(self, t: int, s: int, before: int = 1 << 40) -> bool:
        """Whether the state after token ``t`` has a transition ``s`` once the merges of rank under ``before`` are compiled."""
        left, right, rank, cut, n = self.left, self.right, self.rank, self.cut, self.width
        while True:
            k = cut.get(t * n + s)
            if k is not None and k < before:
                return False  # its own merge has cut it
            a, b = rank[t], rank[s]
            if a < 0 and b < 0:
                return True  # bytes follow one another in the first state
            if a > b:
                t, before = right[t], a  # the state came into being as that of the right part
            elif b > a:
                if not self.lives[s] or t == left[s] == right[s]:
                    return False  # never made, or the gadget of a doubled token has cut this very transition
                s, before = left[s], b  # entered wherever the left part could be
            else:
                if left[t] == right[t]:
                    return True
                t, s, before = right[t], left[s], a

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word by the transition table."""
        whole = self.ids.get(word)
        n = len(word)
        if whole is not None and self.lives[whole]:
            return (whole,)
        prefixes, table, width = self.prefixes, self.table, self.width
        last = [-1] * (n + 1)
        came = [0] * (n + 1)
        for i in range(n):
            state = last[i]
            j = i + 1
            while j <= n:
                token = prefixes.get(word[i:j])
                if token is None:
                    break
                if token >= 0 and last[j] < 0:
                    if state < 0:
                        ok = self.lives[token]
                    else:
                        key = state * width + token
                        ok = table.get(key)
                        if ok is None:
                            if len(table) > 2_000_000:
                                table.clear()
                            ok = table[key] = self.leads(state, token)
                    if ok:
                        last[j], came[j] = token, i
                j += 1
        out = []
        while n:
            out.append(last[n])
            n = came[n]
        return tuple(reversed(out))

    def encode(self, text: str, out: list[int], split=regex.compile(PATTERN).findall) -> None:
        words = self.words
        for w in split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode())
                if len(w) <= KEPT_LENGTH:
                    if len(words) > KEPT_WORDS:
                        words.clear()
                    words[w] = ids
            out += ids

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": {}, "words": {}}


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of each row: the token ids of its text, without special tokens, whose spelling is ordinary text. Null and empty texts
    give an empty array. One narrow pass: the compiled automaton (its size is that of the vocabulary) goes to the executors, texts are encoded whole
    where they are read, and nothing is shuffled. Repeated ids and other columns don't matter; an empty table gives an empty result."""
    automaton = ship(documents.sparkSession, MergeAutomaton.load(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = automaton().encode
        for batch in batches:
            for begin in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(begin, 512)
                flat: list[int] = []
                ends = np.zeros(part.num_rows + 1, np.int32)
                for i, t in enumerate(part.column(1).to_pylist()):
                    if t:
                        encode(t, flat)
                    ends[i + 1] = len(flat)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(scan, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; the empty array gives ''. A null array gives null."""
    automaton = ship(encoded.sparkSession, MergeAutomaton.load(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = automaton().decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id long, text string")


def vocabulary_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, label`` (bytes) of every token: the arc labels."""
    return spark.createDataFrame(sorted(MergeAutomaton.load(vocabulary).labels.items()), "id int, label binary")

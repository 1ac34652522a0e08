"""Evaluation texts inside training texts: q-gram filter over diagonals, then alignment of what is left.

Both sides are reduced to words and these to one stream of letters and digits. A run of item words that a document holds unchanged
shares all its q-grams on one diagonal (document position minus item position); a copy with at most k edited places shares, by the
q-gram lemma, at least (length + 1) - q - k * q of them, spread over as many diagonals as there are insertions. Documents below the least of
these bounds are out; the (document, item) pairs left are counted per band of diagonals, and those that meet their item's bound are aligned within the bands' reach. Copies with more
edits than the budget allows for are found by a bound on rare words that holds for any edits, and aligned over the whole document: no pair of the definition is missed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.plaintext import words
from tidegauge.session import ship

#: Length of the q-grams, in characters of the stream: 6 bits each, so that a q-gram is one exact 64-bit number.
Q = 8
#: A run of so many item words is a leak, and so is this share of the item's words in order.
RUN_WORDS, SHARE = 13, 0.75
#: Edit budget of the filter: edited places (a word dropped, inserted or replaced, or several side by side) per item word.
EDITED_PLACES = 0.25
#: A word is rare if so few items have it: the first of these counts by which an item's rare words can tell (a bound of LEAST_RARE or more), else all its words are counted.
RARE_ITEMS, LEAST_RARE = (3, 6, 12, 25, 50, 100), 3
#: Diagonals per band; bands overlap by half. Bands with fewer shared q-grams are chance.
BAND, BAND_HITS = 32, 4
#: The items travel to every executor; more text than this is refused (work it off in several runs).
MOST_ITEM_CHARS = 8_000_000
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.arange(1, 37)
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def qgrams(stream: np.ndarray) -> np.ndarray:
    """The number of each q-gram of a stream of codes; -1 where it reaches over a separator (code 0)."""
    n = len(stream) - Q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    whole = np.ones(n, bool)
    for j in range(Q):
        part = stream[j : j + n]
        out = (out << 6) | part
        whole &= part > 0
    out[~whole] = -1
    return out


@dataclass
class ItemIndex:
    """The items' q-grams in sorted order, each with its places, and the bounds a document must meet."""

    ids: np.ndarray
    word_lists: list[list[str]]
    word_start: list[np.ndarray]
    grams: np.ndarray
    first: np.ndarray
    place_item: np.ndarray
    place_pos: np.ndarray
    least_run: np.ndarray
    least_share: np.ndarray
    sieve: np.ndarray
    holders: dict[str, list[tuple[int, int]]]
    least_words: list[int]

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> ItemIndex:
        kept = [(i, w) for i, t in items if (w := words(t or ""))]
        lists = [w for _, w in kept]
        starts = [np.cumsum([0, *map(len, w)]) for w in lists]
        grams, item, pos = [], [], []
        for k, w in enumerate(lists):
            g = qgrams(_CODE[np.frombuffer("".join(w).encode(), np.uint8)])
            grams.append(g)
            item.append(np.full(len(g), k))
            pos.append(np.arange(len(g)))
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        unique, first = np.unique(flat[order], return_index=True)
        run, share = [], []
        for w, s in zip(lists, starts, strict=True):
            span = s[RUN_WORDS:] - s[:-RUN_WORDS] if len(w) >= RUN_WORDS else np.array([1 << 40])
            run.append(int(span.min()) - Q + 1)
            places = int(EDITED_PLACES * len(w)) + 1
            share.append(max(int(SHARE * s[-1]) + 1 - Q - places * Q, 2 * Q))
        sieve = np.zeros(1 << 22, bool)
        sieve[(unique ^ (unique >> 22)) & ((1 << 22) - 1)] = True
        # Of SHARE of an item's words at most the rest can be missing, of its rare ones too: so many places must have their word in the document, whatever the edits.
        having = Counter(w for ws in lists for w in set(ws))
        holders: dict[str, list[tuple[int, int]]] = {}
        least_words = []
        for k, ws in enumerate(lists):
            need = int(np.ceil(SHARE * len(ws)))
            for most in RARE_ITEMS:  # the rarest words that can tell
                counted = [w for w in ws if having[w] <= most]
                bound = len(counted) - (len(ws) - need)
                if bound >= LEAST_RARE:
                    break
            else:
                counted, bound = ws, need
            least_words.append(bound)
            for w, n in Counter(counted).items():
                holders.setdefault(w, []).append((k, n))
        join = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
        return cls(np.array([i for i, _ in kept], np.int64), lists, starts, unique, np.r_[first, len(flat)].astype(np.int64), join(item)[order], join(pos)[order],
                   np.array(run, np.int64), np.array(share, np.int64), sieve, holders, least_words)

    def search(self, docs: list[list[str]]) -> list[tuple[int, int]]:
        """(document, item) places of all leaks among ``docs`` (lists of words)."""
        if not len(self.ids) or not docs:
            return []
        gap = "\0" * Q
        text = gap.join("".join(w) for w in docs) + gap
        stream = _CODE[np.frombuffer(text.encode("latin-1"), np.uint8)]
        lengths = np.array([sum(map(len, w)) + Q for w in docs])
        begins = np.cumsum(lengths) - lengths
        grams = qgrams(stream)
        maybe = np.flatnonzero((grams >= 0) & self.sieve[(grams ^ (grams >> 22)) & ((1 << 22) - 1)])
        at = np.searchsorted(self.grams, grams[maybe])
        at[at == len(self.grams)] = 0
        real = self.grams[at] == grams[maybe]
        maybe, at = maybe[real], at[real]
        doc = np.searchsorted(begins, maybe, "right") - 1
        bound = min(self.least_run.min(), self.least_share.min())  # documents below the least bound are out
        enough = np.bincount(doc, minlength=len(docs)) >= bound
        keep = enough[doc]
        maybe, at, doc = maybe[keep], at[keep], doc[keep]
        count = self.first[at + 1] - self.first[at]
        total = np.cumsum(count)
        found: set[tuple[int, int]] = set()
        begin, done = 0, 0
        while begin < len(maybe):  # whole documents, so many that their places fit
            end = int(np.searchsorted(total, done + 4_000_000, "right"))
            end = max(end, begin + 1)
            end = int(np.searchsorted(doc, doc[end], "left")) if end < len(doc) and doc[end] != doc[begin] else int(np.searchsorted(doc, doc[end - 1], "right"))
            found |= self._pairs(docs, maybe[begin:end], at[begin:end], doc[begin:end], count[begin:end], begins)
            begin, done = end, int(total[end - 1])
        return sorted(self._scattered(docs, found))

    def _scattered(self, docs: list[list[str]], found: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Adds copies with more edited places than the budget, or with more text in between than a band holds: pairs that share enough words anywhere are aligned over the whole document."""
        holders, least = self.holders, self.least_words
        for d, ws in enumerate(docs):
            shared: dict[int, int] = {}
            for w in holders.keys() & set(ws):
                for k, n in holders[w]:
                    shared[k] = shared.get(k, 0) + n
            for k, n in shared.items():
                if n >= least[k] and (d, k) not in found and aligned(self.word_lists[k], ws):
                    found.add((d, k))
        return found

    def _pairs(self, docs, pos, at, doc, count, begins) -> set[tuple[int, int]]:
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(self.first[at], count) + within
        item, ipos = self.place_item[place].astype(np.int64), self.place_pos[place].astype(np.int64)
        d, p = np.repeat(doc, count), np.repeat(pos - begins[doc], count)
        pair = d * len(self.ids) + item
        codes, inverse, hits = np.unique(pair, return_inverse=True, return_counts=True)
        least = np.minimum(self.least_run, self.least_share)[codes % len(self.ids)]
        keep = (hits >= least)[inverse]
        pair, p, ipos = pair[keep], p[keep], ipos[keep]
        if not len(pair):
            return set()
        diagonal = p - ipos
        order = np.lexsort((ipos, diagonal, pair))
        pair, ipos, diagonal = pair[order], ipos[order], diagonal[order]
        new = np.r_[True, (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (ipos[1:] != ipos[:-1] + 1)]
        start = np.flatnonzero(new)
        length = np.diff(np.r_[start, len(pair)])
        found: set[tuple[int, int]] = set()
        for s in np.flatnonzero(length >= self.least_run[pair[start] % len(self.ids)]):  # unchanged runs
            i, j = int(ipos[start[s]]), int(ipos[start[s]]) + int(length[s]) + Q - 1
            k = int(pair[start[s]]) % len(self.ids)
            bounds = self.word_start[k]
            if np.searchsorted(bounds, j, "right") - 1 - np.searchsorted(bounds, i, "left") >= RUN_WORDS:
                found.add((int(pair[start[s]]) // len(self.ids), k))
        # Copies with edits: q-grams in bands that aren't chance, against the item's bound.
        wide = np.zeros(len(pair), bool)
        for shift in (0, BAND // 2):
            band = (diagonal + shift) // BAND
            opens = np.r_[True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]
            which = np.cumsum(opens) - 1
            wide |= (np.bincount(which) >= BAND_HITS)[which]
        pairs, inverse = np.unique(pair[wide], return_inverse=True)
        near, far = np.full(len(pairs), 1 << 60), np.full(len(pairs), -(1 << 60))
        np.minimum.at(near, inverse, diagonal[wide])
        np.maximum.at(far, inverse, diagonal[wide])
        seen = np.unique(inverse * (1 << 32) + ipos[wide]) >> 32  # each item place counts once
        shared = np.bincount(seen, minlength=len(pairs))
        for code, n, low, high in zip(pairs, shared, near, far, strict=True):
            d, k = key = (int(code) // len(self.ids), int(code) % len(self.ids))
            if key not in found and n >= self.least_share[k] and aligned(self.word_lists[k], within_band(docs[d], int(low), int(high), int(self.word_start[k][-1]))):
                found.add(key)
        return found


def within_band(doc: list[str], low: int, high: int, length: int) -> list[str]:
    """The words of ``doc`` that an alignment with an item of ``length`` letters can reach on the diagonals from ``low`` to ``high``, widened by the item's length on both
    sides (room for as much inserted or dropped as the item is long)."""
    begins = np.cumsum([0, *map(len, doc)])
    first = int(np.searchsorted(begins, low - length, "right")) - 1
    return doc[max(first, 0) : int(np.searchsorted(begins, high + 2 * length, "left"))]


def aligned(item: list[str], doc: list[str]) -> bool:
    """Whether ``doc`` (the words within a band, or all of them) holds SHARE of the item's words in order: longest common subsequence of the two word sequences, one bit
    per item word."""
    need = int(np.ceil(SHARE * len(item)))
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    row = full = (1 << len(item)) - 1
    for w in doc:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count() >= need


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id`` of each document that holds RUN_WORDS item words in a row, or SHARE of its words in order.

    Items are the side whose size is bounded (and checked): they are collected, indexed once and sent to the executors; documents are read in one
    narrow pass, whole, in batches, without a shuffle. Null and empty texts on either side match nothing; items under RUN_WORDS words can leak
    by their share only; repeated documents are each reported. Empty tables give an empty result."""
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0  # before anything is collected
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"more than {MOST_ITEM_CHARS} characters of items; work them off in parts")
    rows = [(r[0], r[1]) for r in items.select(F.col(item_id).cast("long"), item_text).where(F.col(item_id).isNotNull()).collect()]
    index = ship(documents.sparkSession, ItemIndex.build(sorted(rows, key=lambda r: r[0])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            held, chars, where = [], 0, []
            out: list[tuple[int, int]] = []

            def flush(held=held, where=where, out=out, ids=ids) -> None:
                out += [(ids[where[d]].as_py(), int(items.ids[k])) for d, k in items.search(held)]
                held.clear()
                where.clear()

            for i, t in enumerate(texts.to_pylist()):
                if t:
                    held.append(words(t))
                    where.append(i)
                    chars += len(t)
                    if chars > 2_000_000:
                        flush()
                        chars = 0
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], schema=FOUND)

    return documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(scan, "doc_id long, item_id long")

"""Reading level of documents: graded examples spread over a similarity graph.

The running English prose of a document is reduced to the two figures that readability rests on: words per sentence and letters per word. The nodes of the graph are made from the corpus: pairs of quantiles of
these figures over all documents. A document is linked to the four nodes around it, with bilinear weights, so two documents are the nearer the more nodes they
share. Graded documents are clamped to their grade, and difficulty is propagated until it is harmonic: a node is the weighted mean of its documents, an ungraded
document that of its nodes. Documents being linear in their nodes, one pass over the corpus sums the weights between nodes, and the iterations run on those."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.plaintext import TAG
from tidegauge.session import materialise

#: Quantiles of each figure that nodes are made from, and their rank error.
QUANTILES, RANK_ERROR = 24, 1e-3
#: Weight of an ungraded document against a graded one; of a pull of each node towards the mean grade, as a share of the mean node's weight (it decides where no grade reaches); the largest change at which the iterations end.
UNGRADED, PULL, TOLERANCE = 0.3, 1e-5, 1e-9
#: Words of running prose that a document must have to be judged; grades from this mean on are demanding.
LEAST_WORDS, DEMANDING = 40, 3.5

# Common English words; prose in English has at least this share of them.
COMMON = frozenset(
    "the that this these those each every is are was were be been being a an there of to and or we you they it he she if then by in on at as with from for not no can could may might must will would should do did does has have had its our your their one into than so but when while".split()
)
LEAST_COMMON = 0.15

_FENCED = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.M | re.S)
# Lines that are no running prose: tables, headings, addresses, records, log lines, stack traces, settings.
_OTHER = re.compile(
    r"""^[ \t]*(?:
      \| | \#{1,6}[ ] | \w+://\S*[ \t]*$ | \{.*":.* | \[?\d{4}-\d\d-\d\d[T ]\d | [A-Z][a-z]{2}[ ]+\d{1,2}[ ]\d\d:\d\d:\d\d | panic: | at[ ]\S+\( | Traceback | File[ ]"
      | [\w.\-]+:[ ](?:\S+[ ]?){0,2}$ | [\w.\-]+:[ ][\[{].*[\]}][ ]*$ | --[ ]*$ | \(c\)[ ]
      | .*\blevel=\w+[ ] | [0-9a-fA-F]{24,}[ \t]*$
    ).*$""",
    re.M | re.X,
)
# Lines that may be code; they are if they also lack prose.
_CODE = re.compile(r"^[ \t]*(?:(?:def|class|import|from|return|SELECT|UPDATE|INSERT)[ ].*[(){};=]|.*[{};=].*[{}();=]).*$", re.M)
_CODE_MARK = re.compile(r"[{}();=]")
_BROKEN = re.compile(r"(?<=[a-z])-\n[ \t]*(?=[a-z])")
_NEW_SENTENCE = re.compile(r"(?<=[\w)'\"])[ \t]*\n[ \t]*(?:(?:[-*>•+]|//|\#|\d+[.)])[ \t]+)?(?=[A-Z])")
_MARK = re.compile(r"^[ \t]*(?:[-*>•+]|//|\#|\d+[.)])[ \t]+", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)")
_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]) | {0x2019: 39, 0x2028: 10, 0x2029: 10, 0x85: 10}


def _without_code(line: re.Match) -> str:
    """A line that may be code, empty unless it has prose's share of common words and no more than one mark of code to three words."""
    found = _WORD.findall(line[0].lower())
    prose = sum(map(COMMON.__contains__, found)) >= LEAST_COMMON * len(found) and 3 * len(_CODE_MARK.findall(line[0])) <= len(found)
    return line[0] if prose else ""


def prose_figures(text: str) -> tuple[int, float, float]:
    """Number of words of running English prose, words per sentence and letters per word (0.0 without prose)."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t.translate(_INVISIBLE))
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in t or "~~~" in t:
        t = _FENCED.sub("\n", t)
    if "<" in t:
        t = TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    t = _CODE.sub(_without_code, _OTHER.sub("", t))
    words = sentences = letters = 0
    for paragraph in _PARAGRAPH.split(t):
        if len(paragraph) < 12:
            continue
        p = _MARK.sub("", _NEW_SENTENCE.sub(".\n", _BROKEN.sub("", paragraph)))
        found = _WORD.findall(p.lower())
        n = len(found)
        if n < 3 or sum(map(COMMON.__contains__, found)) < LEAST_COMMON * n:
            continue
        words += n
        letters += sum(map(len, found))
        ends = [m.end() for m in _END.finditer(p)]
        sentences += len(ends) + (not ends or bool(_WORD.search(p[ends[-1] :].lower())))
    return (words, words / sentences, letters / words) if words else (0, 0.0, 0.0)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [prose_figures(t) if t else (0, 0.0, 0.0) for t in batch.column(1).to_pylist()]
        n, s, w = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s.astype(float)), pa.array(w.astype(float)), batch.column(2)], names=["doc_id", "n_words", "sentence", "word", "same"])


def _corners(sentence: np.ndarray, word: np.ndarray, axes: list[list[float]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The cell of each document between the quantiles (beyond the first or last: at the border), and the weights of its links to the four nodes at the corners."""
    places = [np.minimum(np.interp(x, q, np.arange(len(q))), len(q) - 1.001) for x, q in zip((sentence, word), axes, strict=True)]
    a, b = (np.floor(p).astype(np.int64) for p in places)
    u, v = places[0] - a, places[1] - b
    return a, b, [(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v]


_OFFSETS = ((0, 0), (1, 0), (0, 1), (1, 1))
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def harmonic(cells: list, shape: tuple[int, int]) -> np.ndarray:
    """Value of each node, from the sums of each cell (``a, b``; ``u_i_j``: weights between its corners by ungraded documents, ``u_i``, ``g_i``: of its corners by ungraded and graded ones, ``s_i``: grades).
    The conjugate-gradient form of the harmonic iterations, until no node changes by more than TOLERANCE."""
    size = shape[0] * shape[1]
    links, own, pulled = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    graded = grades = 0.0
    for c in cells:
        at = [(c["a"] + x) * shape[1] + c["b"] + y for x, y in _OFFSETS]
        for i, j in _PAIRS:
            links[at[i], at[j]] += UNGRADED * c[f"u_{i}_{j}"]
            if i != j:
                links[at[j], at[i]] += UNGRADED * c[f"u_{i}_{j}"]
        for i in range(4):
            own[at[i]] += UNGRADED * c[f"u_{i}"] + c[f"g_{i}"]
            pulled[at[i]] += c[f"s_{i}"]
            graded += c[f"g_{i}"]
            grades += c[f"s_{i}"]
    pull = PULL * max(own.mean(), 1.0)
    matrix, wanted = np.diag(own + pull) - links, pulled + pull * grades / graded
    scale = np.sqrt(own + pull)  # documents' own weights, so that no node outweighs another
    matrix, wanted = matrix / scale[:, None] / scale[None, :], wanted / scale
    x = np.full(size, grades / graded) * scale
    left = wanted - matrix @ x
    step, power = left.copy(), left @ left
    while power > 0:
        along = matrix @ step
        by = power / (step @ along)
        x += by * step
        left -= by * along
        if np.abs(by * step / scale).max() < TOLERANCE:
            break
        now = left @ left
        step, power = left + now / power * step, now
    return x / scale


def reading_levels(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """``doc_id, n_words, level``: words of running English prose, and the difficulty on the scale of the grades (null under LEAST_WORDS words): the grade of a graded document, else the mean of its nodes.

    Several grades of a text, by several raters or of several copies of it, are averaged, and hold for all its copies; null grades, and grades of documents without enough prose, aren't used. Without any grade all levels are null. Null,
    empty and foreign texts have 0 words. Each row of ``documents`` gives a row, repeated ones the same level; other columns are ignored.
    Of the graph, what leaves the executors is a row of sums per cell, of which there are fewer than QUANTILES * QUANTILES, whatever the corpus."""
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text), F.xxhash64(text).alias("same"))
    rows = materialise(texts.mapInArrow(_figures, "doc_id long, n_words long, sentence double, word double, same long"), "prose")
    alike = ["same", "n_words", "sentence", "word"]  # what copies of a text share
    given = labels.where(F.col(grade).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(grade).cast("double").alias("grade"))
    grades = materialise(rows.where(F.col("n_words") >= LEAST_WORDS).join(given, "doc_id").groupBy(*alike).agg(F.avg("grade").alias("grade")), "grades")
    judged = rows.where(F.col("n_words") >= LEAST_WORDS)
    quantiles = judged.approxQuantile(["sentence", "word"], [i / (QUANTILES - 1) for i in range(QUANTILES)], RANK_ERROR)
    axes = [sorted(set(q)) for q in quantiles]
    axes = [q if len(q) > 1 else [*q, *(x + 1.0 for x in q)] for q in axes]  # all documents alike: one cell

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, weights = _corners(batch.column(1).to_numpy(), batch.column(2).to_numpy(), axes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (a, b, *weights))], names=["grade", "a", "b", "w0", "w1", "w2", "w3"])

    linked = judged.join(grades, alike, "left").select("grade", "sentence", "word").mapInArrow(link, "grade double, a long, b long, w0 double, w1 double, w2 double, w3 double")
    graded = F.col("grade").isNotNull()
    w = [F.col(f"w{i}") for i in range(4)]
    sums = [F.sum(F.when(~graded, w[i] * w[j]).otherwise(0.0)).alias(f"u_{i}_{j}") for i, j in _PAIRS]
    for i in range(4):
        sums += [F.sum(F.when(~graded, w[i]).otherwise(0.0)).alias(f"u_{i}"), F.sum(F.when(graded, w[i]).otherwise(0.0)).alias(f"g_{i}"), F.sum(F.coalesce(w[i] * F.col("grade"), F.lit(0.0))).alias(f"s_{i}")]
    cells = linked.groupBy("a", "b").agg(*sums).collect()
    if not any(c[f"g_{i}"] for c in cells for i in range(4)):
        return rows.select("doc_id", "n_words", F.lit(None).cast("double").alias("level"))
    shape = (len(axes[0]), len(axes[1]))
    values = harmonic(cells, shape)

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, weights = _corners(batch.column(3).to_numpy(), batch.column(4).to_numpy(), axes)
            level = sum(values[(a + x) * shape[1] + b + y] * w for (x, y), w in zip(_OFFSETS, weights, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(level)], names=["doc_id", "n_words", "grade", "free"])

    level = F.when(F.col("n_words") >= LEAST_WORDS, F.coalesce("grade", "free"))
    told = rows.join(grades, alike, "left").select("doc_id", "n_words", "grade", "sentence", "word")
    return told.mapInArrow(free, "doc_id long, n_words long, grade double, free double").select("doc_id", "n_words", level.alias("level"))

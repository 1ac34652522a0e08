"""The text operators: exact round trips, the public library as reference, brute force, held-out grades."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tidegauge.llm import leaks, plaintext, reading, tokenize
from tidegauge.llm.plaintext import words

HAVE = Path(tokenize.VOCABULARY).exists()
needs_files = pytest.mark.skipif(not HAVE, reason="no public tokenizer files here")


def slow_bpe(word, automaton, ranks):
    """Merges applied one after the other, as the definition says."""
    parts = [automaton.ids[bytes([b])] for b in word]
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return tuple(parts)
        rank = best[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == rank:
                out.append(automaton.made[(parts[i], parts[i + 1])])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("seed", range(6))
def test_gadgets_against_merging_on_random_vocabularies(seed):
    rng = random.Random(seed)
    labels = {i: bytes([97 + i]) for i in range(3)}
    merges, ranks, made = [], {}, {}
    for _ in range(25):
        u, v = rng.choice(list(labels)), rng.choice(list(labels))
        b = labels[u] + labels[v]
        if b in labels.values() or len(b) > 9:
            continue
        w = len(labels)
        labels[w] = b
        ranks[(u, v)] = len(merges)
        made[(u, v)] = w
        merges.append((u, v, w))
    automaton = tokenize.MergeAutomaton(labels, merges)
    automaton.made = made
    for _ in range(1500):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert automaton.encode_word(word) == slow_bpe(word, automaton, ranks)


@needs_files
def test_ids_equal_those_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenize.VOCABULARY)
    library.encode_special_tokens = True
    automaton = tokenize.MergeAutomaton.load()
    rng = random.Random(3)
    pieces = ["hello world", "  spaces\t\n\n x", "the thethe", "日本語 текст", "naïve ﬁ", "12345 6", "<|endoftext|>", "it's we'll I'LL", "🔥👩‍🚒", "aaaaaaaaaaaa", "\u0085‍﻿", "======----", " "]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        out = []
        automaton.encode(text, out)
        assert out == library.encode(text, add_special_tokens=False).ids
        assert automaton.decode(out) == text
    long = "abcde fghij " * 200_000
    out = []
    automaton.encode(long, out)
    assert automaton.decode(out) == long


@needs_files
def test_corpus_with_nulls_and_repeats(spark):
    rows = [(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (1, "some text", "x"), (None, "a", "x"), (4, "<|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokenize.encode_corpus(df).collect()]
    automaton = tokenize.MergeAutomaton.load()
    want = []
    for i, t, _ in rows:
        out = []
        automaton.encode(t or "", out)
        want.append((i, out))
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r.doc_id: r.text for r in tokenize.decode_corpus(tokenize.encode_corpus(df)).collect()}
    assert back[1] == "some text" and back[2] == "" and back[3] == "" and back[4] == "<|endoftext|>"
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


ITEM = "A mirror named murdeck-11 hides 4084 of the tallies that dunmere-6 and torwick exchanged, unless quilomere reports fewer than 83 open sessions, and after that brareef-12 answers with code 960."
WORDS = words(ITEM)


@pytest.mark.parametrize(
    "spelt",
    [
        ITEM,
        ITEM.upper(),
        ITEM.replace(" ", "  \n"),
        "> " + ITEM.replace(" that", " that\n> "),
        "# " + ITEM.replace(" and", "\n# and"),
        "<p>" + ITEM.replace(" ", "&nbsp;", 5).replace(",", ",<br/>") + "</p>",
        '{"body": "' + ITEM.replace(", ", ",\\n") + '", "lvl": "info"}',
        ITEM.replace("mirror", "**mirror**").replace("named", "_named_"),
        ITEM.replace("tallies", "tal-\nlies").replace("exchanged", "ex­chang‍ed"),
        ITEM.replace("-", "‑").replace(" ", " "),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM),
        ITEM.replace("o", "о").replace("a", "а"),
        "\n".join(f"May 19 23:44:{i:02d} tsdb: {part}" for i, part in enumerate(ITEM.split(", "))),
        "\n".join(f'{{"ts": 17076, "level": "info", "mod": "relay", "msg": "{part}"}}' for part in ITEM.split(", ")),
    ],
)
def test_spellings_do_not_count(spelt):
    got = words(spelt)
    text = " ".join(got)
    assert " ".join(WORDS) in text, text


def brute(items, docs):
    out = set()
    for k, (i, t) in enumerate(items):
        a = words(t or "")
        for d, u in docs:
            b = words(u or "")
            best, before = 0, {}
            for w in b:
                now = {j: before.get(j - 1, 0) + 1 for j, x in enumerate(a) if x == w}
                best, before = max([best, *now.values()]), now
            row = [0] * (len(a) + 1)
            for w in b:
                for j in range(len(a), 0, -1):
                    if a[j - 1] == w:
                        row[j] = row[j - 1] + 1
                for j in range(1, len(a) + 1):
                    row[j] = max(row[j], row[j - 1])
            if a and (best >= 13 or row[-1] >= math.ceil(0.75 * len(a))):
                out.add((d, i))
        del k
    return out


def leak_fixture():
    rng = random.Random(8)
    names = [a + b for a in ("mur", "dun", "tor", "quil", "bra", "zel", "nes", "kel") for b in ("deck", "mere", "wick", "reef", "vale", "port", "shade", "holm")]
    verbs = "hides returns copies splits answers charges keeps rejects replays hands".split()

    def passage(n):
        return " ".join(f"the {rng.choice(names)}-{rng.randint(1, 99)} {rng.choice(verbs)} {rng.randint(100, 9999)} tallies of {rng.choice(names)} each hour," for _ in range(n))

    items = [(i, passage(8)) for i in range(1, 13)] + [(13, None), (14, ""), (15, items_short := "short item of few words only"), (16, passage(8))]
    filler = "This red graph needs each request and the crew must test it again by noon."
    docs = []
    for i, t in items:
        w = (t or "").split()
        if len(w) < 40:
            continue
        docs.append((len(docs), f"{filler} {t} {filler}"))
        at = rng.randrange(0, len(w) - 20)
        docs.append((len(docs), f"{filler}\n{' '.join(w[at : at + 13])}\n{filler}"))  # exactly thirteen
        docs.append((len(docs), f"{filler}\n{' '.join(w[at : at + 12])}\n{filler}"))  # one short
        edited = [x for x in w if rng.random() > 0.12]
        for _ in range(6):
            edited.insert(rng.randrange(len(edited)), rng.choice(["whole", "later", "usual"]))
        docs.append((len(docs), f"{filler} {' '.join(edited)} {filler}"))
        half = len(w) // 2
        docs.append((len(docs), f"{' '.join(w[:half])} {filler} {' '.join(w[half:])}"))
        docs.append((len(docs), " ".join(w[::2])))
        docs.append((len(docs), " ".join(f"{x} again" for x in w)))  # a word put in behind each
        docs.append((len(docs), " ".join(f"{x} {filler}" for i, x in enumerate(w) if i % 5)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, filler * 400), (len(docs) + 3, items_short), (len(docs) + 4, docs[0][1])]
    return items, docs


def test_leaks_against_brute_force(spark, monkeypatch):
    items, docs = leak_fixture()
    want = brute(items, docs)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leaks.leaked(d, b).collect()} == want
    assert len(want) > 40
    assert leaks.leaked(d.limit(0), b).count() == 0 and leaks.leaked(d, b.limit(0)).count() == 0
    monkeypatch.setattr(leaks, "MOST_ITEM_CHARS", 10)
    with pytest.raises(ValueError, match="in parts"):
        leaks.leaked(d, b)


def test_filter_bounds_hold_for_what_they_promise():
    items, _ = leak_fixture()
    index = leaks.ItemIndex.build([x for x in items if x[1]])
    rng = random.Random(1)
    for k, w in enumerate(index.word_lists):
        if len(w) < 40:
            continue
        at = rng.randrange(0, len(w) - 13)
        assert index.search([w[at : at + 13]]) == [(0, k)]


def test_long_text_and_many_copies():
    items, _ = leak_fixture()
    index = leaks.ItemIndex.build([x for x in items if x[1]])
    text = words(items[0][1])
    filler = words("nothing of interest happens in this very long text at all") * 40_000
    assert index.search([filler + text, filler, *[text] * 50]) == sorted([(0, 0), *[(i, 0) for i in range(2, 52)]])


PROSE = "The crew must test each hot map by noon. The job sends the log to the room. "
HARD = "Under these circumstances, the multidimensional virtualization necessitates the reconfiguration of the heterogeneous infrastructure, notwithstanding the fact that the instrumentation exacerbates the intermittent desynchronization of each asynchronous telemetry. "


def test_figures_count_prose_alone():
    n, sentence, word = reading.prose_figures(PROSE * 3)
    assert n == 51 and math.isclose(sentence, 8.5) and 3 < word < 4
    noise = "2024-10-13 08:49:21 INFO [tsdb] gse index jumped by 70212 for the node\n| host | p99 |\n|---|---|\n## A Heading For The Map\nhttps://x.example/d/1\nservice: a\ninterval: 5s\n```\nSELECT the FROM that;\n```\n"
    assert reading.prose_figures(noise + "\n" + PROSE * 3 + "\n\n" + noise) == (n, sentence, word)
    assert reading.prose_figures("值班期间集群需要重启。" * 20)[0] == 0 and reading.prose_figures("Die Warteschlange wächst, obwohl der Knoten gesund aussieht. " * 9)[0] == 0
    lines = "- The crew must test each hot map by noon\n- The job sends the log to the room\n"
    assert math.isclose(reading.prose_figures(lines * 3)[1], 8.5)
    wrapped = (PROSE * 3).replace("each hot", "each\nhot")
    assert reading.prose_figures(wrapped) == (n, sentence, word)
    assert reading.prose_figures("") == (0, 0.0, 0.0)


def test_levels_of_held_out_documents(spark):
    rng = random.Random(4)
    easy, hard = [s for s in PROSE.split(". ") if s], [HARD.strip()]
    docs, truth = [], {}
    for i in range(400):
        g = rng.choice([1, 2, 3, 4, 5])
        text = " ".join(rng.choice(hard if rng.random() < (g - 1) / 4 else easy).strip(". ") + "." for _ in range(12))
        docs.append((i, text))
        truth[i] = g
    docs += [(1000, None), (1001, ""), (1002, "too short"), (1003, docs[0][1])]
    labels = [(i, f"r{k}", min(5, max(1, truth[i] + rng.choice([0, 0, 0, 1, -1])))) for i in range(0, 400, 5) for k in range(1 + i % 2)] + [(7, "r", None), (5000, "r", 3)]
    d = spark.createDataFrame([(*x, 2) for x in docs], "doc_id long, text string, grade int")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, grade int")
    got = {r.doc_id: (r.n_words, r.level) for r in reading.reading_levels(d, lab).collect()}
    held = [i for i in range(400) if i % 5]
    assert np.corrcoef([got[i][1] for i in held], [truth[i] for i in held])[0, 1] > 0.85
    assert got[1000] == (0, None) and got[1001] == (0, None) and got[1002][1] is None and got[1003] == got[0]
    none = reading.reading_levels(d, lab.limit(0))
    assert none.where("level is not null").count() == 0
    assert reading.reading_levels(d.limit(0), lab).count() == 0
    assert Counter(truth.values())


def test_semicolons_entities_and_tags_leave_prose():
    lines = ["the queue that it feeds is longer than the one before; the node that reads it waits; so the batch is late.", "from the store (which is the oldest of them) it takes what the others have left; that is all it does."]
    whole = reading.prose_figures("\n".join(lines))
    assert whole[0] == sum(len(reading._WORD.findall(x)) for x in lines)
    marked = ['<p class="a" id="b">' + lines[0].replace("queue that", "queue&nbsp;that").replace("it feeds", "it&nbsp;feeds") + "</p>", lines[1]]
    assert reading.prose_figures("\n".join(marked)) == whole
    for code in ("for (int i = 0; i < n; i++) { if (this.is(i)) { do(i); } }", "x = the_value; y = other(x);", "return this.of(a); }", "from queue import (the, node)"):
        assert reading.prose_figures("\n".join([*lines, code])) == whole


def test_tags_of_any_length_are_markup():
    long = 'two <a\n href="' + "x" * 5000 + '" title=\'b\n c\'>three</a> four <br> five <!-- six\nseven --> eight'
    assert plaintext.words(long) == ["two", "three", "four", "five", "eight"]
    assert plaintext.words("load <5 and more\n> quoted a < b\nand c > d") == ["load", "5", "and", "more", "quoted", "a", "b", "and", "c", "d"]


def test_alignment_within_its_band():
    doc = [f"w{i}" for i in range(1000)]
    begins = np.cumsum([0, *map(len, doc)])
    low = int(begins[500])
    part = leaks.within_band(doc, low, low + 10, 40)
    assert set(doc[500:512]) <= set(part) and len(part) < 60
    assert leaks.within_band(doc, -50, -20, 40)[0] == "w0"


def test_harmonic_values_are_the_means_of_their_neighbours():
    """Two graded and two ungraded documents on a line of three nodes: the ungraded ones are the means of their nodes, the nodes of their documents."""
    zero = {f"u_{i}_{j}": 0.0 for i, j in reading._PAIRS} | {f"{k}_{i}": 0.0 for k in "ugs" for i in range(4)}
    cells = [zero | {"a": 0, "b": 0, "g_0": 1.0, "s_0": 1.0, "u_0": 1.0, "u_1": 1.0, "u_0_0": 0.5, "u_0_1": 0.5, "u_1_1": 0.5}, zero | {"a": 1, "b": 0, "g_1": 1.0, "s_1": 5.0}]
    f = reading.harmonic(cells, (3, 2)).reshape(3, 2)[:, 0]
    u = reading.UNGRADED
    free = (f[0] + f[1]) / 2
    assert abs(f[0] - (1.0 + u * free) / (1 + u)) < 1e-3 and abs(f[1] - free) < 1e-3 and abs(f[2] - 5) < 1e-3


def test_copies_of_a_graded_document_have_its_grade(spark):
    d = spark.createDataFrame([(1, PROSE * 3), (2, PROSE * 3), (3, HARD * 12), (4, HARD * 12)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 2), (2, 3), (3, 5)], "doc_id long, grade int")
    got = {r.doc_id: r.level for r in reading.reading_levels(d, lab).collect()}
    assert got == {1: 2.5, 2: 2.5, 3: 5.0, 4: 5.0}

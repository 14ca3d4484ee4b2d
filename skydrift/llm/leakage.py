"""Passages of held-out items inside a large corpus.

Texts are compared as runs of letters and digits, whatever their case, punctuation, mark-up,
line breaks or choice of code points. Every item is cut into windows of the least number of
consecutive words that counts as a passage; every document is cut into windows of the same
sizes, and of up to ``max_edits`` words fewer and more, at each of its words: a word left out or
put in makes a passage shorter or longer. All are padded to one width. The CGK random walk embeds a window so that a small edit distance
(in words) becomes a small Hamming distance; bit-sampling keys of the embedding, repeated until
a pair within ``max_edits`` meets in some key with probability ``recall``, give the candidate
pairs, and each of these is verified by its exact edit distance. Equal windows have equal
embeddings and meet in every key, so verbatim passages are found always.

Words that stand in no item are all alike to an item: each costs at least one edit, and so does
each word that a window is short of, so windows with more than ``max_edits`` of both can't match
and are dropped before they are embedded; so are longer windows that begin or end with such a
word, as the window without it is at least as near. Those are bounds, not heuristics, and spare
nearly all of the corpus the embedding.

The items are the stated query set: they are taken in blocks of about ``block_chars`` characters (an item
that is longer is a block of its own), each block's windows being broadcast (the block bounds their number and bytes) to all documents, which are
read whole and never shuffled; only the few hits are.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNSEEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿︀-️]")
_MARKS = re.compile(r"[*`~]+|(?<!\w)_+|_+(?!\w)|</?[A-Za-z][^<>\n]{0,60}>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑¬][ \t]*\r?\n[ \t>|#*]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_COMBINING = re.compile("[̀-ͯ]")
#: Cyrillic and Greek letters that look like Latin ones, and those.
_ALIKE = str.maketrans("аеорсухіјѕԁһАВЕКМНОРСТУХІЈЅονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTYXIJSovABEZHIKMNOPTYX")
#: A number in groups of three after a first group of at most three, and one written without.
_GROUPED = re.compile(r"(?<!\S)\d{1,3}(?: \d{3})+(?!\S)")
_LONG = re.compile(r"(?<![^\W_])\d{4,}(?![^\W_])")
UNKNOWN, PAD, FIRST = 0, 1, 2
MOST_REPETITIONS = 400


def plain(text: str) -> str:
    """The text in one choice of code points, in small letters, without mark-up."""
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text)).translate(_ALIKE)
    if "*" in text or "_" in text or "`" in text or "<" in text or "~" in text:
        text = _MARKS.sub("", text)
    return text.casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def merged(ws: list[str]) -> list[str]:
    """The words with grouped thousands ('70', '423') as one number ('70423')."""
    line = " ".join(ws)
    short = _GROUPED.sub(lambda m: m.group().replace(" ", ""), line)
    return ws if short == line else short.split(" ")


def readings(text: str) -> list[tuple[bool, list[str]]]:
    """The ways to read a text as words: (thousands merged, words).

    A hyphen at a line end may divide one word or join two, and a number written without
    separators may stand for one written with them; such texts are read both ways.
    """
    base = plain(text)
    plains = [base]
    if "\n" in base and (joined := _BREAK.sub("", base)) != base:
        plains.append(joined)
    out = []
    for p in plains:
        ws = _WORD.findall(p)
        out.append((False, ws))
        if _LONG.search(p):
            out.append((True, merged(ws)))
    return out


class RandomWalk:
    """CGK embedding of words 0..vocabulary into strings of three times the length."""

    def __init__(self, length: int, vocabulary: int, seed: int):
        self.steps, self.seed = 3 * length, seed
        self.bits = np.random.default_rng(seed).integers(0, 2, (self.steps, vocabulary), dtype=np.int8)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        m, n = windows.shape
        padded = np.concatenate([windows, np.full((m, 1), PAD, windows.dtype)], axis=1)
        at, rows = np.zeros(m, np.int64), np.arange(m)
        out = np.empty((m, self.steps), np.int32)
        for j in range(self.steps):
            word = padded[rows, at]
            out[:, j] = word
            at = np.minimum(at + self.bits[j, word], n)
        return out


def sampled_keys(windows: np.ndarray, walks: list[RandomWalk], bits: int) -> Iterator[np.ndarray]:
    """Per walk a 64-bit key of each window: ``bits`` places of the embedding, sampled with the walk."""
    for walk in walks:
        rng = np.random.default_rng(walk.seed)
        places = rng.choice(walk.steps, min(bits, walk.steps), replace=False)
        odd = rng.integers(1, 1 << 63, len(places), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = ((walk(windows)[:, places].astype(np.uint64) + np.uint64(1)) * odd).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield h ^ (h >> np.uint64(29))


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise edit distance of two matrices of words (unknown words equal nothing)."""
    m, n = a.shape
    k = b.shape[1]
    row = np.tile(np.arange(k + 1, dtype=np.int16), (m, 1))
    for i in range(n):
        diff = (a[:, i : i + 1] != b) | (a[:, i : i + 1] == UNKNOWN)
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(k):
            new[:, j + 1] = np.minimum(np.minimum(new[:, j], row[:, j + 1]) + 1, row[:, j] + diff[:, j])
        row = new
    return row[:, -1]


def padded(windows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(windows, ((0, 0), (0, width - windows.shape[1])), constant_values=PAD)


def plan_repetitions(length: int, max_edits: int, bits: int, recall: float, seed: int, trials: int = 1000) -> int:
    """Repetitions after which windows ``max_edits`` apart meet with probability ``recall``.

    Estimated on random windows of ``length`` words with random edits, for each number of words
    that insertions and deletions may add or take in all; the worst of these counts.
    """
    if max_edits == 0:
        return 1
    rng = np.random.default_rng(seed)
    width = length + max_edits
    walks = [RandomWalk(width, 500, seed + k) for k in range(40)]
    most = 1
    for change in range(-max_edits, max_edits + 1):
        a = rng.integers(FIRST, 500, (trials, length))
        changed = []
        for row in a.tolist():
            pairs = int(rng.integers(0, (max_edits - abs(change)) // 2 + 1))
            put, cut = max(change, 0) + pairs, max(-change, 0) + pairs
            for p in rng.choice(length, max_edits - put - cut, replace=False):
                row[p] = int(rng.integers(FIRST, 500))
            for _ in range(cut):
                del row[int(rng.integers(0, len(row)))]
            for _ in range(put):  # a word put in at an end leaves the passage as it was
                row.insert(int(rng.integers(1, max(2, len(row)))), int(rng.integers(FIRST, 500)))
            changed.append(row)
        x, y = padded(a, width), padded(np.array(changed), width)
        # how likely one repetition, with a walk of its own, lets each pair meet: all places drawn are alike
        meet = np.zeros(trials)
        for w in walks:
            same, drawn = (w(x) == w(y)).sum(axis=1), np.arange(min(bits, w.steps))
            meet += (np.maximum(same[:, None] - drawn, 0) / (w.steps - drawn)).prod(axis=1) / len(walks)
        while ((1 - meet) ** most).mean() > 1 - recall:
            most += 1
            if most > MOST_REPETITIONS:
                raise ValueError(f"windows of {length} words {max_edits} edits apart don't meet with probability {recall} in {MOST_REPETITIONS} repetitions of {bits} places; take fewer places")
    return most


@dataclass
class ItemWindows:
    """All windows of one length, with their keys (padded to ``width``) sorted per repetition."""

    windows: np.ndarray
    width: int
    item: np.ndarray
    walks: list[RandomWalk]
    bits: int
    keys: list[np.ndarray]
    order: list[np.ndarray]

    @classmethod
    def of(cls, windows: np.ndarray, item: np.ndarray, max_edits: int, vocabulary: int, bits: int, repetitions: int, seed: int) -> ItemWindows:
        width = windows.shape[1] + max_edits
        walks = [RandomWalk(width, vocabulary, seed + k) for k in range(repetitions)]
        keys = list(sampled_keys(padded(windows, width), walks, bits))
        order = [np.argsort(k, kind="stable") for k in keys]
        return cls(windows, width, item, walks, bits, [k[o] for k, o in zip(keys, order)], order)

    def candidates(self, windows: np.ndarray) -> np.ndarray:
        """Pairs (row of windows, row of self.windows), each once; windows may be shorter or longer by up to the edits allowed."""
        found = []
        for key, known, order in zip(sampled_keys(padded(windows, self.width), self.walks, self.bits), self.keys, self.order):
            a = np.searchsorted(known, key, "left")
            n = np.searchsorted(known, key, "right") - a
            if total := int(n.sum()):
                q = np.repeat(np.arange(len(n)), n)
                at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                found.append(np.unique(q * len(self.windows) + order[at]))
        if not found:
            return np.zeros((0, 2), np.int64)
        pair = np.unique(np.concatenate(found))
        return np.stack([pair // len(self.windows), pair % len(self.windows)], axis=1)


class Detector:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], least_words: int, max_edits: int, recall: float, bits: int, seed: int):
        self.max_edits = max_edits
        runs: dict[tuple[bool, int], tuple[list, list]] = {}
        self.vocabulary: dict[str, int] = {}
        code = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST)
        for item, text in items:
            ws = words(text or "")
            for p in range(len(ws) - least_words + 1):
                part = ws[p : p + least_words]
                forms = [(False, part)]
                if len(short := merged(part)) < len(part):
                    forms.append((True, short))
                for is_merged, form in forms:
                    w, i = runs.setdefault((is_merged, len(form)), ([], []))
                    w.append([code(x) for x in form])
                    i.append(item)
        size = len(self.vocabulary) + FIRST
        planned = {n: plan_repetitions(n, max_edits, bits, recall, seed) for _, n in runs}
        self.tables = {
            key: ItemWindows.of(np.array(w, np.int32), np.array(i, np.int64), max_edits, size, bits, planned[key[1]], seed) for key, (w, i) in runs.items()
        }

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, edits) of every matching pair of text and item, edits the fewest seen."""
        hits: list[np.ndarray] = []
        known, unknown = self.vocabulary.get, repeat(UNKNOWN)
        read = [(k, m, ws) for k, text in enumerate(texts) if text for m, ws in readings(text)]
        for is_merged in (False, True):
            tables = [(n, t) for (m, n), t in self.tables.items() if m == is_merged]
            if not tables:
                continue
            flat = array("i")
            walls: list[int] = []  # where a text ends: no window reaches over it
            whose: list[int] = []
            for k, m, ws in read:
                if m == is_merged:
                    flat.extend(map(known, ws, unknown))
                    walls.append(len(flat))
                    whose.append(k)
                    flat.append(UNKNOWN)
            codes = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
            owners = np.repeat(np.array(whose, np.int64), np.diff(np.array([-1, *walls])))
            strange = np.concatenate(([0], np.cumsum(codes == UNKNOWN)))
            ends = np.zeros(len(codes) + 1, np.int64)
            ends[np.array(walls, np.int64) + 1] = 1
            ends = np.cumsum(ends)
            sizes = [(n, k, t) for n, t in tables for k in range(max(1, n - self.max_edits), n + self.max_edits + 1)]
            for n, k, t in sizes:
                if len(codes) < k:
                    continue
                spare = self.max_edits - max(0, n - k)
                fit = (strange[k:] - strange[:-k] <= spare) & (ends[k:] == ends[:-k])
                if k > n:
                    fit &= (codes[: len(fit)] != UNKNOWN) & (codes[k - 1 :] != UNKNOWN)
                start = np.nonzero(fit)[0]
                if not len(start):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(codes, k)[start]
                kinds, back = np.unique(windows, axis=0, return_inverse=True)
                back = back.ravel()
                pair = t.candidates(kinds)
                edits = np.empty(len(pair), np.int16)
                for a in range(0, len(pair), 65536):
                    p = pair[a : a + 65536]
                    x, y = kinds[p[:, 0]], t.windows[p[:, 1]]
                    d = np.where((x == y).all(axis=1), 0, np.int16(1)) if self.max_edits == 0 else edit_distance(x, y)
                    edits[a : a + 65536] = d
                ok = edits <= self.max_edits
                per = np.unique(np.stack([pair[ok, 0], t.item[pair[ok, 1]], edits[ok]], axis=1), axis=0)
                # windows of one kind may stand in several texts
                by = np.argsort(back, kind="stable")
                lo = np.searchsorted(back[by], per[:, 0], "left")
                cnt = np.searchsorted(back[by], per[:, 0], "right") - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt) + np.arange(int(cnt.sum())) if len(cnt) else lo
                hits.append(np.stack([owners[start[by[at]]], np.repeat(per[:, 1], cnt), np.repeat(per[:, 2], cnt)], axis=1))
        if not hits:
            none = np.zeros(0, np.int64)
            return none, none, none
        all_ = np.concatenate(hits)
        all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
        first = np.ones(len(all_), bool)
        first[1:] = (all_[1:, :2] != all_[:-1, :2]).any(axis=1)
        return all_[first, 0], all_[first, 1], all_[first, 2]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    least_words: int = 13,
    max_edits: int = 1,
    recall: float = 0.95,
    bits: int = 10,
    block_chars: int = 4_000_000,
    seed: int = 20,
) -> DataFrame:
    """doc_id, item_id, edits: documents that hold ``least_words`` consecutive words of an item.

    edits is the smallest edit distance, in words exchanged, put in or left out, of any such
    passage: 0 where it stands there word for word (found always), up to ``max_edits`` otherwise
    (found with probability ``recall`` each). Null and empty texts hold nothing, items of fewer words can't leak, and
    rows without an id are ignored. A document given twice counts once.
    """
    spark = documents.sparkSession
    stated = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    # blocks by hash of the id: of about the size asked for, and all rows of an item in one
    n_blocks = -(-int(stated.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // block_chars)
    block_of = F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(max(1, n_blocks)))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    schema = "doc_id long, item_id long, edits int"
    out = spark.createDataFrame([], schema)
    for k in range(n_blocks):
        rows = [(r.item_id, r.text) for r in stated.where(block_of == k).collect()]
        sent = spark.sparkContext.broadcast(Detector(sorted(rows), least_words, max_edits, recall, bits, seed))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                t, i, e = sent.value.find(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[t]), pa.array(i), pa.array(e.astype(np.int32))], names=["doc_id", "item_id", "edits"]
                )

        got = docs.mapInArrow(find, schema)
        out = got if n_blocks == 1 else out.unionByName(got)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))

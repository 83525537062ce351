"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, computed by the forward algorithm; a text's is the product over its words. Words are runs
of non-space bytes with the vocabulary's word mark in front, so that no piece crosses words and each distinct word of a
block is summed once. Piece probabilities are learnt by expectation maximisation: expected piece counts over all
segmentations (forward and backward sums) of the words of the training texts, added up by Spark. Pieces for single bytes
keep every word possible.

Training uses, of each language, all labelled rows or a sample of about TRAIN_DOCS of them, chosen by a hash of the id,
whichever is less (a documented parameter); languages without a training row are left out; every row is scored. The score
is the posterior chance of the predicted language under the language shares of all labelled rows.

Long words, as in scripts without spaces, are cut where no piece of the vocabulary crosses: every segmentation has a
boundary there, so the sums of the parts multiply to the sum of the whole. Scoring keeps only as many columns of forward
sums as the longest piece has bytes.

Defined cases: null text, empty text and text without a letter is `und` with score 0; if nothing can be learnt, all rows
are; null langs are not learnt from; rows of one doc_id each get their row; repeated rows get equal results; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm.staging import staged

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS, ROUNDS, SMOOTHING = 5_000, 2, 0.02
MARK, BLOCK, LONG, CACHED, CELLS = b" ", 4 << 20, 60, 1_000_000, 1 << 21
LETTER = regex.compile(r"\p{L}")


class Pieces:
    """The vocabulary as byte strings (its word mark is a space here), found by the hash of their bytes in two tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        texts = [t.replace("▁", " ").encode() for t in usual if "▁" not in t[1:]]
        known = set(texts)
        self.texts = texts + [bytes([b]) for b in range(256) if bytes([b]) not in known]
        self.longest = max(map(len, self.texts))
        buf = np.frombuffer(b"".join(self.texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.hashes = np.append(at.span_hash(at.byte_prefix(buf), off[:-1], off[1:]), at.U64(0))
        self.tables, rest, shift = [], np.arange(len(self.texts)), 44
        while len(rest):  # pieces that share a slot go to the next table
            slots = self._slots(self.hashes[rest], shift)
            table = np.full(1 << 20, len(self.texts), np.int32)
            table[slots] = rest
            self.tables.append((shift, table))
            rest, shift = rest[table[slots] != rest], shift - 9

    @staticmethod
    def _slots(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> at.U64(shift)) & at.U64((1 << 20) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of pieces, and of which."""
        which, number = [], []
        for shift, table in self.tables:
            found = table[self._slots(hashes, shift)]
            hit = np.flatnonzero(self.hashes[found] == hashes)
            which.append(hit)
            number.append(found[hit])
        return np.concatenate(which), np.concatenate(number)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(words: list[bytes], probabilities: np.ndarray, vocabulary: Pieces, expected: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Words x languages: log of the summed probability of all segmentations.

    With expected (pieces x languages), adds each piece's expected count under word weights (words x languages).
    Words advance together, the longest first, so that those still running are a prefix; so many are taken at once that
    the sums of one step have about CELLS cells. Without expected, only the last columns of sums are kept.
    """
    out = np.zeros((len(words), probabilities.shape[1]))
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-length, kind="stable")
    prefix = at.byte_prefix(np.frombuffer(b"".join(words), np.uint8))
    base = (np.cumsum(length) - length)[order]
    ordered = length[order]
    begin = 0
    while begin < len(words):
        longest = int(ordered[begin])
        depth = longest + 1 if expected is not None else min(longest, vocabulary.longest) + 1
        m = min(len(words) - begin, max(1, CELLS // depth))
        own, first = ordered[begin : begin + m], base[begin : begin + m]
        logs = np.zeros((depth, m, probabilities.shape[1]))  # a scale of its own for each language: none underflows
        arcs = []
        for end in range(1, longest + 1):
            live, here, before = int(np.searchsorted(-own, -end, side="right")), end % depth, (end - 1) % depth
            total = np.zeros((live, probabilities.shape[1]))
            for k in range(1, min(end, vocabulary.longest) + 1):
                hit, number = vocabulary.find(at.span_hash(prefix, first[:live] + end - k, first[:live] + end))
                if len(hit):
                    # sums are kept in the scale of the position before
                    total[hit] += probabilities[number] if k == 1 else np.exp(logs[(end - k) % depth, hit] - logs[before, hit]) * probabilities[number]
                    if expected is not None:
                        arcs.append((end, k, hit, number))
            logs[here, :live] = logs[before, :live] + np.log(total)
            done = np.flatnonzero(own[:live] == end)
            out[order[begin + done]] = logs[here, done]
        if expected is not None:
            # the chance of a boundary at each position, passed down along the pieces that end there
            boundary = np.zeros_like(logs)
            boundary[own, np.arange(m)] = 1.0
            share = weight[order[begin : begin + m]]
            for end, k, hit, number in reversed(arcs):
                flow = np.exp(logs[end - k, hit] - logs[end, hit]) * probabilities[number] * boundary[end, hit]
                boundary[end - k, hit] += flow
                np.add.at(expected, number, flow * share[hit])
        begin += m
    return out


def crossed(text: bytes, vocabulary: Pieces) -> np.ndarray:
    """For each inner position 1 .. len - 1 of a word, whether a piece of the vocabulary found there crosses it."""
    prefix = at.byte_prefix(np.frombuffer(text, np.uint8))
    edge = np.zeros(len(text) + 1, np.int64)
    for k in range(2, min(len(text), vocabulary.longest) + 1):
        start = np.arange(len(text) - k + 1)
        hit, _ = vocabulary.find(at.span_hash(prefix, start, start + k))
        np.add.at(edge, hit + 1, 1)
        np.add.at(edge, hit + k, -1)
    return np.cumsum(edge)[1 : len(text)] > 0


def word_list(buf: np.ndarray, off: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Distinct parts of a block's words (their hashes and bytes), each part's number, and row pointers.

    A word with its mark is one part; one of over LONG bytes gives several where no piece crosses.
    """
    starts, ends, ptr = at.word_spans(buf, off)
    text = buf.tobytes()
    marked = np.ones(len(starts), bool)
    cuts = [(w, np.flatnonzero(~crossed(MARK + text[starts[w] : ends[w]], vocabulary)) + starts[w]) for w in np.flatnonzero(ends - starts > LONG)]
    cuts = [(w, c[c > starts[w]]) for w, c in cuts]  # the mark itself is never parted from its word
    if cuts:
        parts = np.ones(len(starts), np.int64)
        parts[[w for w, _ in cuts]] += [len(c) for _, c in cuts]
        head = np.concatenate([[0], np.cumsum(parts)])
        marked = np.zeros(head[-1], bool)
        marked[head[:-1]] = True
        begin, end = np.repeat(starts, parts), np.repeat(ends, parts)
        for w, c in cuts:
            begin[head[w] + 1 : head[w + 1]] = c
            end[head[w] : head[w + 1] - 1] = c
        starts, ends, ptr = begin, end, head[ptr]
    hashes = at.span_hash(at.byte_prefix(buf), starts, ends) ^ np.where(marked, at.U64(0), at.U64(0x9E3779B97F4A7C15))
    codes, distinct = pd.factorize(hashes)
    where = np.zeros(len(distinct), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    spans = zip(marked[where].tolist(), starts[where].tolist(), ends[where].tolist(), strict=True)
    return distinct, [(MARK if m else b"") + text[a:b] for m, a, b in spans], codes, ptr


class WordScores:
    """Log probabilities of words per language; those already summed are remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index, self.rows = pd.Index(np.zeros(0, np.uint64)), np.zeros((0, len(self.model.langs)))

    def of(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        at_ = self.index.get_indexer(pd.Index(hashes))
        new = np.flatnonzero(at_ < 0)
        out = np.zeros((len(words), len(self.model.langs)))
        out[at_ >= 0] = self.rows[at_[at_ >= 0]]
        if len(new):
            out[new] = forward([words[k] for k in new], self.model.probabilities, pieces(self.model.path))
            if len(self.index) + len(new) > CACHED:
                self._clear()
            self.index, self.rows = self.index.append(pd.Index(hashes[new])), np.concatenate([self.rows, out[new]])
        return out


class Model:
    def __init__(self, langs: list[str], prior: np.ndarray, probabilities: np.ndarray, path: str):
        self.langs, self.prior, self.probabilities, self.path = langs, prior, probabilities, path


def learnt(docs: DataFrame, usable: Callable, path: str = VOCABULARY, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from the rows for which usable(doc_id column) holds and lang is not null."""
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter(usable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(shares)
    vocabulary = pieces(path)
    uniform = np.full((len(vocabulary.texts), max(1, len(langs))), 1.0 / len(vocabulary.texts))
    if not langs:
        return Model([], np.zeros(0), uniform, path)
    per_lang = lambda values: F.create_map(*[F.lit(x) for pair in zip(langs, values, strict=True) for x in pair])[F.col("lang")]
    whole = 1 << 40
    sample = able.filter(F.pmod(F.xxhash64(F.lit(8), F.col("doc_id"), "text"), F.lit(whole)) < per_lang([min(whole, -(-whole * train_docs // shares[name])) for name in langs]))
    number = per_lang(range(len(langs)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in at.blocks(batches, limit=BLOCK):
            _, words, codes, ptr = word_list(buf, off, pieces(path))
            lang = rows.column(0).to_numpy(zero_copy_only=False)[at.row_of(ptr)].astype(np.int64)
            both, n = np.unique(codes * len(langs) + lang, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((both % len(langs)).astype(np.int32)), pa.array([words[k] for k in both // len(langs)], pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counts = sample.select(number.alias("lang"), "text").mapInArrow(counted, "lang int, word binary, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = staged(counts.repartition(F.col("word")), "words")
    probabilities = uniform
    for _ in range(rounds):
        current = probabilities

        def expectation(batches: Iterator[pa.RecordBatch], current: np.ndarray = current) -> Iterator[pa.RecordBatch]:
            expected = np.zeros_like(current)
            for batch in batches:
                frame = batch.to_pandas()
                codes, words = pd.factorize(frame["word"])
                weight = np.zeros((len(words), len(langs)))
                np.add.at(weight, (codes, frame["lang"].to_numpy()), frame["n"].to_numpy())
                forward(list(words), current, pieces(path), expected, weight)
            piece, lang = np.nonzero(expected > 0)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(expected[piece, lang])], names=["piece", "lang", "n"])

        got = counts.select("word", "lang", "n").mapInArrow(expectation, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages
        sums = np.full_like(uniform, SMOOTHING)
        sums[got["piece"], got["lang"]] += got["n"]
        probabilities = sums / sums.sum(axis=0)
    seen = np.flatnonzero((sums > SMOOTHING).any(axis=0)) if rounds else np.arange(len(langs))
    prior = np.array([shares[langs[k]] for k in seen], float)
    return Model([langs[k] for k in seen], prior / max(prior.sum(), 1.0), probabilities[:, seen], path)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        scores = WordScores(model)
        for rows, buf, off in at.blocks(batches, limit=BLOCK):
            texts = rows.column(1).to_pylist()
            known = np.array([bool(t and LETTER.search(t)) for t in texts]) & bool(model.langs)
            best, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
            if known.any():
                hashes, words, codes, ptr = word_list(buf, off, pieces(model.path))
                logs = scores.of(hashes, words)
                total = np.zeros((len(texts), len(model.langs)))
                for k in range(len(model.langs)):
                    sums = np.concatenate([[0.0], np.cumsum(logs[codes, k])])
                    total[:, k] = sums[ptr[1:]] - sums[ptr[:-1]] + math.log(model.prior[k])
                top = total.argmax(axis=1)
                chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best[known], score[known] = top[known], chance[known]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id, parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text falls into the held-out part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = learnt(docs, lambda i: ~held_out(i), path)
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

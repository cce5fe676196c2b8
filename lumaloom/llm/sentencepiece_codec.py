"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words (a run of blanks and what follows; no piece reaches
over such a border).  The distinct words are counted over all documents.  For a
word all substrings up to the longest piece are exploded and equi-joined to the
piece table; the edges are grouped by word, which needs no shuffle because the
words are already dealt by themselves; a higher-order aggregate folds each
lattice into a path.

Two folds exist.  ``viterbi`` takes the path of the largest score sum, as
unigram models do.  For a BPE model that path is wrong (a piece's score is its
merge rank): on sampled words it differs from the library's pieces for about
60 %.  ``merge`` therefore folds in the model's own order: it joins, as long as
there is an edge over two neighbours, the pair whose edge scores best, the left
one if tied.

The most frequent words, at most ``WORDS``, are encoded this way once and
broadcast as a table (its size is bounded).  Each of the others occurs a few
times only; the task that meets one builds the same lattice from the broadcast
piece table and folds it alike.  So no text or word occurrence is shuffled.

Defined results: a null doc_id is as good as any; null and empty texts have no ids and decode to the empty
string; a character without piece becomes its bytes; repeated rows are encoded
each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANK = "▁"
#: Words that are encoded once for all and broadcast.
WORDS = 200_000
#: Longer words are left to the tasks; the fold's work grows with the square of the length.
LONGEST = 48
BORDER = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


class Pieces:
    """What encoding needs of a model file: pieces with scores, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.id, self.byte, self.text = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece], self.text[i] = i, sp.get_score(i), piece
        self.longest = max(map(len, self.id), default=1)
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.bytes = [bytes([self.of_byte[i]]) if i in self.of_byte else self.text.get(i, "").encode() for i in range(sp.get_piece_size())]

    def ids(self, word: str, bounds) -> list[int]:
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            i = self.id.get(word[a:b])
            out += [i] if i is not None else [self.byte[x] for x in word[a:b].encode()]
        return out

    def merged(self, word: str) -> list[int]:
        """The merge fold in a task: lattice edges by lookup, best edge first, leftmost if tied."""
        if len(word) <= LONGEST:
            return self._merged_short(word)
        n, score, longest = len(word), self.score, self.longest
        left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours of each border 0..n
        alive = [True] * (n + 1)
        edge = lambda m: None if left[m] < 0 or right[m] > n or right[m] - left[m] > longest else score.get(word[left[m] : right[m]])
        heap = [(-s, m, left[m], right[m]) for m in range(1, n) if (s := edge(m)) is not None]
        heapify(heap)
        while heap:
            _, m, a, b = heappop(heap)
            if not alive[m] or left[m] != a or right[m] != b:
                continue
            alive[m] = False
            right[a], left[b] = b, a
            for x in (a, b):
                if 0 < x < n and (s := edge(x)) is not None:
                    heappush(heap, (-s, x, left[x], right[x]))
        return self.ids(word, [x for x in range(n + 1) if alive[x]])

    def _merged_short(self, word: str) -> list[int]:
        """The same fold over the list of pieces, which is faster while that is short."""
        get, none = self.score.get, float("-inf")
        parts = list(word)
        edges = [get(a + b, none) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        while edges and (best := max(edges)) > none:
            i = edges.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del edges[i]
            if i:
                edges[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(edges):
                edges[i] = get(parts[i] + parts[i + 1], none)
        out = []
        for x in parts:
            i = self.id.get(x)
            out += [i] if i is not None else [self.byte[b] for b in x.encode()]
        return out

    def decode(self, ids) -> str:
        out = b"".join([self.bytes[i] for i in ids])
        text = out.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def normalised(text: Column) -> Column:
    """Blanks become visible and one is put in front, as the model's normaliser does."""
    return F.when(F.length(text) > 0, F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK))))


def words(text: Column) -> Column:
    return F.split(normalised(text), f"(?<=[^{BLANK}])(?={BLANK})")


def lattice(distinct_words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """distinct_words(word) x pieces(piece, score) -> word, edges (map of 1000 * start + end to score)."""
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.transform(F.sequence(a + 1, F.least(a + longest, n)), lambda b: F.struct((a * 1000 + b).alias("at"), F.substring("word", a + 1, b - a).alias("piece")))))
    cut = distinct_words.select("word", F.explode(spans).alias("x")).select("word", "x.at", "x.piece")
    edges = cut.join(F.broadcast(pieces), "piece", "left")
    # a word without any edge stays: its characters become bytes
    found = edges.groupBy("word").agg(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("at", "score"))).alias("edges"))
    return found.select("word", F.map_from_entries("edges").alias("edges"))


def fold_merge(word: Column, edges: Column) -> Column:
    """Borders of the pieces after joining neighbours, best edge first."""
    n = F.length(word)

    def step(borders: Column, _: Column) -> Column:
        inner = F.sequence(F.lit(1), F.size(borders) - 2)
        scored = F.transform(inner, lambda i: F.struct(F.try_element_at(edges, F.get(borders, i - 1) * 1000 + F.get(borders, i + 1)).alias("score"), (-i).alias("at")))
        best = F.array_max(F.filter(scored, lambda x: x["score"].isNotNull()))
        drop = lambda top: F.when(top.isNull(), borders).otherwise(F.filter(borders, lambda b, i: i != -top["at"]))
        return F.when(F.size(borders) < 3, borders).otherwise(F.element_at(F.transform(F.array(best), drop), 1))

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def fold_viterbi(word: Column, edges: Column, longest: int) -> Column:
    """Borders of the path with the largest sum of scores; a character without an edge costs more than any piece."""
    n = F.length(word)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, b: Column) -> Column:
        ways = F.transform(
            F.sequence(F.greatest(b - longest, F.lit(0)), b - 1),
            lambda a: F.struct((F.get(best, a)["score"] + F.coalesce(F.try_element_at(edges, a * 1000 + b).cast("double"), F.when(b - a == 1, F.lit(-1e4)))).alias("score"), F.concat(F.get(best, a)["path"], F.array(b)).alias("path")),
        )
        return F.concat(best, F.array(F.array_max(F.filter(ways, lambda x: x["score"].isNotNull()))))

    return F.aggregate(F.sequence(F.lit(1), n), first, step, lambda best: F.element_at(best, -1)["path"])


class Encoder:
    """text -> ids: words that are known from the lattice, and others folded where they are met."""

    def __init__(self, pieces: Pieces, known: dict[str, list[int]]):
        self.pieces, self.known = pieces, known

    def __call__(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            get, merged = self.known.get, self.pieces.merged
            for w in BORDER.split(BLANK + text.replace(" ", BLANK)):
                ids += get(w) or merged(w)
        return ids


def known_words(docs: DataFrame, model: str, most_words: int = WORDS) -> dict[str, list[int]]:
    """Ids of the most frequent words of all documents, by the lattice; at most ``most_words`` of at most ``LONGEST`` characters."""
    spark = docs.sparkSession
    pieces = Pieces(model)
    table_of = spark.createDataFrame(pd.DataFrame({"piece": list(pieces.score), "score": list(pieces.score.values())}))
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    hot = counts.filter((F.col("n") > 1) & (F.length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(most_words).select("word")
    hot = hot.repartition("word")
    folded = lattice(hot, table_of, pieces.longest).select("word", fold_merge(F.col("word"), F.col("edges")).alias("borders")).toPandas()
    return {w: pieces.ids(w, b) for w, b in zip(folded["word"], folded["borders"], strict=True)}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that ids of few texts are held as Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def encode(docs: DataFrame, model: str, most_words: int = WORDS) -> DataFrame:
    """doc_id, text, ids (array of int) of every row of docs(doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(known_words(docs, model, most_words))

    def run(batches):
        coder = Encoder(Pieces(model), known.value)
        for batch in _slices(batches):
            ids = pa.array([np.array(coder(t), dtype=np.int32) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    some = docs.select("doc_id", "text")
    return some.mapInArrow(run, f"doc_id {dict(some.dtypes)['doc_id']}, text string, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """coded(ids, ...) with the text of the ids as ``decoded``."""

    def run(batches):
        pieces = Pieces(model)
        for batch in _slices(batches):
            text = pa.array([pieces.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in coded.dtypes) + ", decoded string")


def round_trip(docs: DataFrame, model: str, most_words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned, little-endian unsigned 32-bit ids), round_trip (whether decoding gives the text back).

    Encoding and decoding of a text follow each other in one task, so ids are not carried on.
    """
    known = docs.sparkSession.sparkContext.broadcast(known_words(docs, model, most_words))

    def run(batches):
        pieces = Pieces(model)
        coder = Encoder(pieces, known.value)
        for batch in _slices(batches):
            n, crc, same = [], [], []
            for t in batch.column("text").to_pylist():
                ids = coder(t)
                n.append(len(ids))
                crc.append(zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
                same.append(pieces.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    some = docs.select("doc_id", "text")
    return some.mapInArrow(run, f"doc_id {dict(some.dtypes)['doc_id']}, n_tokens long, ids_crc32 long, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

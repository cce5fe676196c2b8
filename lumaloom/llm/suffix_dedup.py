"""Removing byte strings that repeat anywhere in the corpus, by sparse suffix sorting.

A string of ``length`` bytes that starts at two places is found exactly:

1. Every window of ``length`` bytes selects the ``GRAM``-byte grams of smallest
   hash in it (all, when tied).  The choice depends on the window's content
   only, so two equal windows select grams at the same offset.  These anchors
   are about 1 % of positions.
2. Anchors whose gram occurs once need no more work.  The others bring the
   bytes around them that a window can reach.
3. The suffixes of one gram are sorted to the right of the anchor and, mirrored,
   to its left: multikey quicksort on 8-byte characters to a shallow depth, then
   a blind trie for each group that still shares a longer prefix.  From the two
   orders and their common-prefix lengths follows for every offset which
   anchors start equal windows.

Grams with more than ``big`` occurrences never meet in one task: their windows
are counted by hash in a plain aggregation.

Defined results: null and empty texts have 0 bytes and the hash of nothing;
texts under ``length`` bytes stay; very long texts are one document, whole; places
with the same bytes are alike, there is no first one to stay.  In the query rows
that repeat a doc_id, and rows without one, are documents of their own; for
:func:`remove_repeats` doc_id is the key, and rows that repeat one with the same
text are copies of each other, rows without one are kept whole.  Extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

LENGTH, GRAM = 200, 32
SHALLOW = 64
BIG = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
        step = np.uint64(int(step) ** 2 & (1 << 64) - 1)
    return out


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each full window of ``width`` values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


class AnchorFinder:
    """Anchors of many texts at once; keeps the tables of powers between batches."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.power) < n:
            self.power = _powers(n, _BASE)
            self.inverse = _powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """index of the text, position in it and gram hash of each anchor."""
        none = np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
        keep = [i for i, t in enumerate(texts) if len(t) >= self.length]
        if not keep:
            return none
        sizes = np.array([len(texts[i]) for i in keep])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts[i] for i in keep), dtype=np.uint8)
        n = len(data)
        self._tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        h = (total[self.gram :] - total[: n - self.gram + 1]) * self.inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        small = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        width = self.length - self.gram + 1
        low = _sliding(small, width, np.minimum)
        for end in begin[1:-1]:  # windows across two texts select nothing
            low[max(0, end - self.length + 1) : end] = 0
        high = np.zeros(n - self.gram + 1 + width - 1, dtype=np.uint32)
        high[width - 1 : width - 1 + len(low)] = low
        at = np.flatnonzero(_sliding(high, width, np.maximum) == small)
        text = np.searchsorted(begin, at, side="right") - 1
        return np.array(keep)[text], at - begin[text], h[at]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = a[:n], b[:n]
    if x == y:
        return n
    return n - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() // 8 - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() % 8 > 0)


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: int = -1):
        self.depth, self.leaf, self.kids = depth, leaf, {}


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """Members in order of their strings.  Inner nodes hold a depth and branch on
    one byte; a string goes down blindly, is compared once with the leaf it
    meets, and is hung in at the depth of their first difference."""
    byte = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root = _Node(-1, members[0])
    same: dict[int, list[int]] = {}
    for i in members[1:]:
        s = strings[i]
        node = root
        while node.leaf < 0:
            node = node.kids.get(byte(i, node.depth)) or next(iter(node.kids.values()))
        d = common_prefix(s, strings[node.leaf])
        if d == len(s) == len(strings[node.leaf]):
            same.setdefault(node.leaf, []).append(i)
            continue
        other = node.leaf
        node, parent, way = root, None, None
        while node.leaf < 0 and node.depth < d:
            parent, way = node, byte(i, node.depth)
            node = node.kids[way]
        if node.leaf < 0 and node.depth == d:
            node.kids[byte(i, d)] = _Node(-1, i)
            continue
        branch = _Node(d)
        branch.kids[byte(other, d)] = node
        branch.kids[byte(i, d)] = _Node(-1, i)
        if parent is None:
            root = branch
        else:
            parent.kids[way] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf >= 0:
            out.append(node.leaf)
            out += same.get(node.leaf, [])
        else:
            stack += [node.kids[k] for k in sorted(node.kids, reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices in order of the strings: multikey quicksort on 8-byte characters
    down to ``shallow`` bytes; what is still together goes to a blind trie."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out.append(part[0])
            continue
        if depth < 0:  # all these strings are equal
            out += part
            continue
        if depth >= shallow:
            out += blind_trie(strings, part)
            continue
        key = {i: (strings[i][depth : depth + 8].ljust(8, b"\0"), len(strings[i]) - depth if len(strings[i]) < depth + 8 else 8) for i in part}
        pivot = sorted((key[part[0]], key[part[len(part) // 2]], key[part[-1]]))[1]
        less = [i for i in part if key[i] < pivot]
        equal = [i for i in part if key[i] == pivot]
        more = [i for i in part if key[i] > pivot]
        if more:
            stack.append((more, depth))
        stack.append((equal, depth + 8 if pivot[1] == 8 else -1))
        if less:
            stack.append((less, depth))
    return out


def prefix_classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank order and the common prefix of each string with the one before it in order."""
    order = deep_shallow_sort(strings)
    lcp = np.zeros(len(order), dtype=np.int64)
    for k in range(1, len(order)):
        lcp[k] = common_prefix(strings[order[k - 1]], strings[order[k]])
    return np.array(order), lcp


def repeated_offsets(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For each distinct context of one gram the runs [lo, hi] of offsets l for which the
    window that starts l bytes before the anchor also starts at another place.

    lefts are mirrored: the byte next to the anchor comes first.
    """
    most = length - gram
    whole = [(max(0, length - len(r)), min(most, len(x))) for x, r in zip(lefts, rights, strict=True)]
    runs: list[list[tuple[int, int]]] = [[w] if n > 1 and w[0] <= w[1] else [] for w, n in zip(whole, counts, strict=True)]
    if len(lefts) == 1:
        return runs
    if len(lefts) == 2:
        lo, hi = max(0, length - common_prefix(rights[0], rights[1])), min(most, common_prefix(lefts[0], lefts[1]))
        return [r if r or lo > hi else [(lo, hi)] for r in runs]
    m = len(lefts)
    order_r, lcp_r = prefix_classes(rights)
    order_l, lcp_l = prefix_classes(lefts)
    edges = sorted({0, most + 1} | {int(x) + 1 for x in lcp_l if x < most} | {length - int(x) for x in lcp_r if length - most <= x <= length})
    class_l, class_r = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # no class changes from lo to hi - 1
        class_l[order_l] = np.cumsum(lcp_l < lo)
        class_r[order_r] = np.cumsum(lcp_r < length - lo)
        _, back, n = np.unique(class_l * (m + 1) + class_r, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(n[back] > 1):
            if counts[i] == 1 and whole[i][0] <= lo and hi - 1 <= whole[i][1]:
                if runs[i] and runs[i][-1][1] == lo - 1:
                    runs[i][-1] = (runs[i][-1][0], hi - 1)
                else:
                    runs[i].append((lo, hi - 1))
    return runs


def _spans_in_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, start, end of repeated stretches; rows come sorted by gram and a gram's rows may span batches."""
    out: list[tuple[int, int, int]] = []
    gram, rows = None, []

    def close() -> None:
        if len(rows) < 2:
            return
        where: dict[tuple[bytes, bytes], list[int]] = {}
        for i, r in enumerate(rows):
            where.setdefault((r[2], r[3]), []).append(i)
        ways = list(where)
        runs = repeated_offsets([w[0] for w in ways], [w[1] for w in ways], [len(x) for x in where.values()])
        for r, at in zip(runs, where.values(), strict=True):
            for lo, hi in r:
                out.extend((rows[i][0], rows[i][1] - hi, rows[i][1] - lo + LENGTH) for i in at)

    for pdf in batches:
        columns = [pdf[c].tolist() for c in ("gram", "doc_id", "pos", "end", "left", "right")]
        for g, doc, pos, end, left, right in zip(*columns, strict=True):
            if end:  # a span that its document knew
                out.append((doc, pos, end))
                continue
            if g != gram:
                close()
                gram, rows = g, []
            rows.append((doc, pos, left, right))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["doc_id", "start", "end"])
            out.clear()
    close()
    yield pd.DataFrame(out, columns=["doc_id", "start", "end"], dtype="int64")


def _windows_of_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of a context by a 128-bit hash: for grams too frequent for one task."""
    for pdf in batches:
        for a in range(0, len(pdf), 500):
            part = pdf.iloc[a : a + 500]
            rows = []
            for left, right, doc, pos in zip(part["left"], part["right"], part["doc_id"], part["pos"], strict=True):
                s = bytes(left)[::-1] + bytes(right)
                rows += [(hashlib.blake2b(s[i : i + LENGTH], digest_size=16).digest(), doc, pos - len(left) + i) for i in range(max(0, len(s) - LENGTH + 1)) if i <= len(left)]
            yield pd.DataFrame(rows, columns=["window", "doc_id", "start"])


def repeated_spans(docs: DataFrame, scratch: Scratch, big: int = BIG) -> DataFrame:
    """doc_id, text (bytes), starts and ends (arrays, by start) of documents that hold repeated strings."""
    body = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter(f"octet_length(text) >= {LENGTH} and doc_id is not null")

    def anchors_of(batches):
        finder = AnchorFinder()
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            texts = [bytes(t) for t in pdf["text"]]
            a = 0
            while a < len(texts):  # about half a MB at a time
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 1 << 19):
                    size += len(texts[b])
                    b += 1
                i, pos, h = finder.find(texts[a:b])
                yield pd.DataFrame({"gram": h.view(np.int64), "doc_id": ids[a:b][i], "pos": pos.astype(np.int32)})
                a = b

    anchors = scratch.save(body.mapInPandas(anchors_of, "gram long, doc_id long, pos int"), "anchors")
    often = anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", (F.col("n") > big).alias("big"))
    lists = anchors.join(often, "gram").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "gram", "big")).alias("x")).select("doc_id", F.col("x.pos").alias("at"), F.col("x.gram").alias("grams"), F.col("x.big").alias("bigs"))
    held = scratch.save(body.join(lists, "doc_id"), "held")
    scratch.drop("anchors")
    scratch.release()

    def contexts(batches):
        """A row for each different context of a document.  Places that share one (periodic text) are
        repeats already: their spans go straight on, and one of them stands for all."""
        names = ["gram", "big", "doc_id", "pos", "end", "left", "right"]
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text, at, grams, bigs in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["at"], pdf["grams"], pdf["bigs"], strict=True):
                first: dict[tuple[bytes, bytes], int] = {}
                known: list[tuple[int, int]] = []
                for p, g, b in sorted(zip(at.tolist(), grams.tolist(), bigs.tolist(), strict=True)):
                    left, right = text[max(0, p - LENGTH + GRAM) : p][::-1], text[p : p + LENGTH]
                    q = first.setdefault((left, right), p)
                    if q == p:
                        rows.append((g, b, doc, p, 0, left, right))
                    elif len(left) + len(right) >= LENGTH:
                        known += [(x - len(left), x + len(right)) for x in (q, p)]
                if known:
                    known.sort()
                    rows += [(doc, False, doc, a, e, b"", b"") for a, e in merged(np.array([x[0] for x in known]), np.array([x[1] for x in known]))]
                if len(rows) > 5_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    near = held.mapInPandas(contexts, "gram long, big boolean, doc_id long, pos int, end int, left binary, right binary")
    usual = near.filter("not big").repartition("gram").sortWithinPartitions("gram").mapInPandas(_spans_in_groups, "doc_id long, start long, end long")
    windows = near.filter("big").mapInPandas(_windows_of_contexts, "window binary, doc_id long, start long")
    # a window near several anchors comes several times; a place counts once
    places = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("a"), F.max(F.struct("doc_id", "start")).alias("b")).filter("a != b").select("window")
    hot = windows.join(places, "window", "left_semi").select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))
    if not held.filter("exists(bigs, x -> x)").isEmpty():
        usual = usual.unionByName(hot)
    spans = usual.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("x")).select("doc_id", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))
    spans = scratch.save(spans, "spans")
    scratch.release()
    return held.select("doc_id", "text").join(spans, "doc_id")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans sorted by start, joined where they overlap or touch."""
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return list(zip(starts[new].tolist(), reach[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, big: int = BIG) -> DataFrame:
    """doc_id, n_removed, n_spans, kept (bytes that stay) of the documents that lose bytes."""
    found = repeated_spans(docs, Scratch(docs.sparkSession, "suffix"), big)

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, text, starts, ends in zip(pdf["doc_id"], pdf["text"], pdf["starts"], pdf["ends"], strict=True):
                text, at, kept = bytes(text), 0, []
                runs = merged(starts, ends)
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rows.append((doc, sum(b - a for a, b in runs), len(runs), b"".join(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_removed", "n_spans", "kept"])

    return found.mapInPandas(cut, "doc_id long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: ids may repeat or be null, so rows go by a number, written with their texts so that every step sees the same one."""
    docs = table(spark, sf_dir, "documents")
    rows = Scratch(spark, "rows").save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "rows")
    lost = remove_repeats(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("d"), "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    whole = rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return whole.join(lost, whole["row"] == lost["d"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256")
    )

"""Substring deduplication: suffix automata of reference shards give each window the smallest document that has it.

``without_reference`` broadcasts the shards of a reference corpus round by round and streams every document through them. ``substring_dedup`` has the
corpus itself as reference; there a window is sent to the one shard that can hold it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiform.llm.common import documents, drop_written, give_back, settle, slices, written
from lexiform.llm.words import window_hashes, word_hashes

#: Words of a window: what repeats over so many consecutive words is removed.
WINDOW = 50
#: Words of a gram; each window is represented by its smallest gram.
GRAM = 8
#: Words of one reference shard, which bounds an automaton, and of the shards that are broadcast at once.
SHARD_WORDS, ROUND_WORDS = 40_000, 1_000_000
#: Contexts of one anchor from which on its windows are told apart one by one; ids of such anchors that are broadcast at most.
HOT, SMALL = 1000, 1 << 20
#: Words of the longer grams by which contexts of a hot anchor are cut again, one after the other.
LONGER = (25, 38)
#: What a window has that stands in no reference document.
NONE = 1 << 62


class SuffixAutomaton:
    """A generalised suffix automaton over lists of word numbers; each state knows the smallest document of its end positions."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = array("i", [-1]), array("i", [0]), array("q", [NONE])

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.length.append(length)
        self.low.append(NONE)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The clone of ``q`` for the strings that reach it from ``p``."""
        moves, link, length = self.next, self.link, self.length
        clone = self._state(length[p] + 1, moves[q].copy())
        link[clone] = link[q]
        link[q] = clone
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = clone
            p = link[p]
        return clone

    def add(self, words: list[int], doc: int) -> None:
        moves, link, length, low = self.next, self.link, self.length, self.low
        last = 0
        for c in words:
            q = moves[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                cur, p = self._state(length[last] + 1, {}), last
                while p >= 0 and c not in moves[p]:
                    moves[p][c] = cur
                    p = link[p]
                if p < 0:
                    link[cur] = 0
                else:
                    q = moves[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = cur
            if doc < low[last]:
                low[last] = doc

    def finish(self) -> None:
        """Hands each state's smallest document to the states of its suffixes."""
        for v in np.argsort(np.frombuffer(self.length, np.int32))[::-1].tolist():
            up = self.link[v]
            if up >= 0 and self.low[v] < self.low[up]:
                self.low[up] = self.low[v]

    def matches(self, words: list[int], window: int) -> Iterator[int]:
        """For each window of ``words``, in order: the smallest document that has it, or NONE.

        Streams the words once, keeping the longest suffix that the automaton has, cut to ``window`` words (matching statistics).
        """
        v = size = 0
        moves, link, length, low = self.next, self.link, self.length, self.low
        for i, c in enumerate(words):
            while v and c not in moves[v]:
                v = link[v]
                size = length[v]
            if c in moves[v]:
                v = moves[v][c]
                size += 1
            if size > window:
                size = window
            while v and length[link[v]] >= size:
                v = link[v]
            if i >= window - 1:
                yield low[v] if size == window else NONE


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window) for each gram that is the smallest of some windows of a text.

    Every window has one such gram, chosen by its words alone, so equal windows have equal ones.
    """
    g = window_hashes(words, gram)
    if len(words) < window:
        z = np.zeros(0, np.int64)
        return g[:0], z, z
    m = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[first]], first, np.append(first[1:], len(at)) - 1


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id): the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [np.unique(anchors(w)[0]) for w, _, _ in word_hashes([(t.as_py() or "").encode() for t in b.column(1)])]
            size = np.array([len(f) for f in found])
            if size.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))], ["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


#: What the pass over the texts writes: finished documents, candidates with their texts, and contexts around shared anchors.
PARTS = "kind string, doc_id long, th long, n_words long, sha string, text string, h long, c1 long, c2 long, first int, windows int, context string"


def parts(rows: DataFrame) -> DataFrame:
    """PARTS from (doc_id, text, shared, th): ``shared`` are the document's anchors that another document has too, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string()), *((c, pa.int64()) for c in ("h", "c1", "c2")), ("first", pa.int32()), ("windows", pa.int32()), ("context", pa.string())])
        for b in slices(batches):
            raw = [(t.as_py() or "").encode() for t in b.column(1)]
            out: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                nonlocal held
                made = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)
                out.clear()
                held = 0
                return made

            for i, (w, s, e) in enumerate(word_hashes(raw)):
                doc, text, shared, th = b.column(0)[i].as_py(), raw[i], b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if not shared:
                    out.append(("done", doc, th, len(w), kept_digest(text.split()), None, None, None, None, None, None, None))
                    continue
                out.append(("text", doc, th, len(w), None, text.decode(), None, None, None, None, None, None))
                held += len(text)
                g, lo, hi = anchors(w)
                for k in np.flatnonzero(np.isin(g, np.array(shared, np.int64).view(np.uint64))).tolist():
                    a, z = int(lo[k]), int(hi[k]) + WINDOW
                    context = b" ".join(text[s[a] : e[z - 1]].split())
                    d = hashlib.blake2b(context, digest_size=16).digest()
                    out.append(("context", doc, th, None, None, None, int(g[k : k + 1].view(np.int64)[0]), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), a, z - WINDOW - a + 1, context.decode()))
                    held += len(context)
                    if held > 2_000_000:  # a repetitive text has a context for nearly each of its words
                        yield flush()
                if held > 2_000_000:
                    yield flush()
            if out:
                yield flush()

    return rows.select("doc_id", "text", "shared", "th").mapInArrow(run, PARTS)


def lowest(contexts: DataFrame) -> DataFrame:
    """(c1, c2, low): for each distinct context (h, c1, c2, context, doc) the smallest document of each of its windows.

    ``contexts`` arrives with an anchor's contexts together. Runs of anchors make a reference shard of SHARD_WORDS words, whose
    automaton the shard's own contexts are streamed through; an anchor with more than a shard's words has several shards, and its
    contexts pass each. An anchor with one context needs none: its windows occur nowhere else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, list[int]]] = []

        def solve(group: list[tuple]) -> None:
            number: dict[str, int] = {}
            texts = [[number.setdefault(w, len(number)) for w in r[3].split(" ")] for r in group]
            low = [None] * len(group)
            i = 0
            while i < len(group):
                ref, size = SuffixAutomaton(), 0
                while i < len(group) and size < SHARD_WORDS:
                    ref.add(texts[i], group[i][4])
                    size += len(texts[i])
                    i += 1
                ref.finish()
                for k, words in enumerate(texts):
                    got = list(ref.matches(words, WINDOW))
                    low[k] = got if low[k] is None else list(map(min, low[k], got))
            done.extend((r[1], r[2], x) for r, x in zip(group, low, strict=True))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.list_(pa.int64()))], ["c1", "c2", "low"])
            done.clear()
            return out

        shard: list[tuple] = []
        own: list[tuple] = []
        size = 0
        for b in slices(batches):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own and own[0][0] != r[0]:
                    if len(own) == 1:
                        done.append((own[0][1], own[0][2], [own[0][4]] * (own[0][3].count(" ") + 2 - WINDOW)))
                    else:
                        shard += own
                        size += sum(x[3].count(" ") + 1 for x in own)
                    own = []
                    if size >= SHARD_WORDS:
                        solve(shard)
                        shard, size = [], 0
                        give_back()
                    if len(done) > 5000:
                        yield flush()
                own.append(r)
        if len(own) == 1:
            done.append((own[0][1], own[0][2], [own[0][4]] * (own[0][3].count(" ") + 2 - WINDOW)))
        else:
            shard += own
        if shard:
            solve(shard)
        if done:
            yield flush()

    return contexts.select("h", "c1", "c2", "context", "doc").mapInArrow(run, "c1 long, c2 long, low array<long>")


def window_rows(contexts: DataFrame) -> DataFrame:
    """(c1, c2, i, d1, d2, doc) for the i-th window of each context, d1 and d2 being its 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for c1, c2, context, doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = context.split(" ")
                for i in range(len(words) - WINDOW + 1):
                    d = hashlib.blake2b(" ".join(words[i : i + WINDOW]).encode(), digest_size=16).digest()
                    out.append((c1, c2, i, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["c1", "c2", "i", "d1", "d2", "doc"])

    return contexts.select("c1", "c2", "context", "doc").mapInArrow(run, "c1 long, c2 long, i int, d1 long, d2 long, doc long")


def earlier(rows: DataFrame) -> DataFrame:
    """(c1, c2, i, x): those of ``window_rows`` whose window also stands in a context of a smaller document, x being the smallest."""
    best = rows.groupBy("d1", "d2").agg(F.min("doc").alias("x"), F.max("doc").alias("hi")).where("x < hi").select("d1", "d2", "x")
    return rows.join(best, ["d1", "d2"]).where("x < doc").select("c1", "c2", "i", "x")


def cut_rows(contexts: DataFrame, gram: int) -> DataFrame:
    """(c1, c2, first, h, s1, s2, context, doc): each context cut where the smallest gram of ``gram`` words of its windows changes.

    A cut's windows start at ``first`` in the context; together the cuts have each of its windows once. ``h`` comes from the context's anchor and that gram, so equal
    windows have equal ones; s1 and s2 are the digest of the cut's words. A context has as many cuts as windows at most, and mostly two or three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for (c1, c2, h, context, doc), (w, s, e) in zip(rows, word_hashes([r[3].encode() for r in rows]), strict=True):
                text = context.encode()
                for g, a, z in zip(*(x.tolist() for x in anchors(w, gram=gram)), strict=True):
                    cut = text[s[a] : e[z + WINDOW - 1]]
                    d = hashlib.blake2b(cut, digest_size=16).digest()
                    out.append((c1, c2, a, h, g - (1 << 63), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), cut.decode(), doc))
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["c1", "c2", "first", "h", "g", "s1", "s2", "context", "doc"])

    made = contexts.select("c1", "c2", "h", "context", "doc").mapInArrow(run, "c1 long, c2 long, first int, h long, g long, s1 long, s2 long, context string, doc long")
    return made.select("c1", "c2", "first", F.xxhash64("h", "g").alias("h"), "s1", "s2", "context", "doc")


def lowest_of_all(distinct: DataFrame, longer: tuple[int, ...] = LONGER) -> DataFrame:
    """``lowest``, where no anchor's contexts meet in one task beyond HOT of them.

    The contexts of an anchor with more are cut by a longer gram, whose equal cuts are one context, and so on by the grams of ``longer``: contexts that differ somewhere
    part, and what they share is kept once. What is hot then is cut into its windows; equal ones meet by their digests, with map-side combine. Only
    windows that also stand in a context of a smaller document are joined with it; the others have their own context's.
    """
    hot = written(distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"), "hot")
    few = F.broadcast(hot) if hot.count() <= SMALL else hot  # broadcast: a checked number of ids
    rest = distinct.join(few, "h", "left_anti")
    low = written(lowest(rest.repartition("h").sortWithinPartitions("h", "c1", "c2")), "lowest")
    if hot.isEmpty():
        return low
    around = distinct.join(few, "h", "left_semi")
    if longer:
        cuts = written(cut_rows(around, longer[0]), "cuts")
        once = cuts.groupBy("s1", "s2").agg(F.first("h").alias("h"), F.first("context").alias("context"), F.min("doc").alias("doc"))
        inner = lowest_of_all(written(once.withColumnsRenamed({"s1": "c1", "s2": "c2"}), "contexts"), longer[1:])
        found = cuts.select("c1", "c2", "first", "s1", "s2").join(inner.select(F.col("c1").alias("s1"), F.col("c2").alias("s2"), "low"), ["s1", "s2"])
        per = found.groupBy("c1", "c2").agg(F.array_sort(F.collect_list(F.struct("first", "low"))).alias("w"))  # at most a context's own windows
        return low.union(per.select("c1", "c2", F.flatten("w.low").alias("low")))
    rows = written(window_rows(around), "windows")
    per = earlier(rows).groupBy("c1", "c2").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("w"))  # at most a context's own windows
    own = around.select("c1", "c2", "doc", F.expr(f"sequence(0, size(split(context, ' ')) - {WINDOW})").alias("at"))
    low_of = F.expr("transform(at, i -> coalesce(try_element_at(w, i), doc))")
    return low.union(own.join(per, ["c1", "c2"], "left").select("c1", "c2", low_of.alias("low")))


def finished(rows: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text where asked for) from (doc_id, n_words, text, starts): windows at ``starts`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, sha, kept = [], [], []
            for text, starts in zip(b.column(2), b.column(3), strict=True):
                words = text.as_py().encode().split()
                change = np.zeros(len(words) + WINDOW + 1, np.int64)
                s = np.array(starts.as_py() or [], np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, s + WINDOW, -1)
                gone = np.cumsum(change)[: len(words)] > 0
                left = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                n.append(int(gone.sum()))
                sha.append(kept_digest(left))
                if with_text:
                    kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return rows.select("doc_id", "n_words", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless ``with_text`` is off, kept_text (null for documents that keep every word) for every row of ``docs`` (doc_id, text).

    A word goes when some window of 50 consecutive words over it also starts in a document with a smaller doc_id; windows are those of the
    input. A null text has no words. Repeats within a document stay. Rows without a doc_id are no reference and lose nothing. Rows that repeat a
    doc_id lose nothing to each other. An empty table gives an empty result.

    Equal windows have equal smallest grams ("anchors"). Only around anchors that two documents have are words compared: the words of the
    windows an anchor stands for are sent to the anchor's reference shard, whose suffix automaton tells the smallest document of each.
    The shards are shipped by shuffle and not by broadcast, since the reference is the corpus itself and grows with it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    known = rows.where("doc_id IS NOT NULL")
    found = written(anchor_rows(known), "anchors")
    shared = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    own = written(found.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared")), "own")  # at most a document's own anchors
    drop_written(found)
    del found, shared
    settle(docs.sparkSession)  # before the texts are shuffled
    table = written(parts(rows.join(own.hint("merge"), "doc_id", "left")), "parts")
    drop_written(own)
    settle(docs.sparkSession)

    around = table.where("kind = 'context'").select("h", "c1", "c2", "context", F.col("doc_id").alias("doc"))
    distinct = around.groupBy("c1", "c2").agg(F.first("h").alias("h"), F.first("context").alias("context"), F.min("doc").alias("doc"))
    once = written(distinct, "contexts")
    settle(docs.sparkSession)
    low = lowest_of_all(once)
    places = table.where("kind = 'context'").select("doc_id", "th", "c1", "c2", "first")
    hits = places.join(low, ["c1", "c2"]).select("doc_id", "th", F.expr("filter(transform(low, (x, i) -> if(x < doc_id, first + i, -1)), x -> x >= 0)").alias("at")).where("size(at) > 0")
    hits = hits.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("at")).alias("starts"))  # at most a text's own windows
    texts = table.where("kind = 'text'").select("doc_id", "th", "n_words", "text")
    changed = finished(texts.join(hits.hint("merge"), ["doc_id", "th"], "left"), with_text)
    same = table.where("kind = 'done'").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *([F.lit(None).cast("string").alias("kept_text")] if with_text else []))
    return changed.union(same)


def reference_pieces(reference: DataFrame) -> DataFrame:
    """(id, n, piece): the words of the reference texts in pieces of at most SHARD_WORDS words, which overlap by less than a window; short texts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (t.as_py() or "").encode().split()
                for at in range(0, max(len(words) - WINDOW + 1, 0), SHARD_WORDS - WINDOW + 1):
                    part = words[at : at + SHARD_WORDS]
                    out.append((i, len(part), b" ".join(part).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["id", "n", "piece"])

    return reference.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, n long, piece string")


def rounds(pieces: DataFrame) -> Iterator[list[list[tuple[int, str]]]]:
    """The pieces in rounds of at most twice ROUND_WORDS words, each as shards of at most SHARD_WORDS words (or one piece)."""
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-total // ROUND_WORDS))
    turn = lambda m: F.pmod(F.xxhash64("id", "piece"), F.lit(m))
    while pieces.groupBy(turn(count)).agg(F.sum("n").alias("n")).where(F.col("n") > 2 * ROUND_WORDS).limit(1).count():
        count *= 2
    for r in range(count):
        shards, size = [[]], 0
        for x in pieces.where(turn(count) == r).collect():  # at most twice ROUND_WORDS words
            if size and size + x.n > SHARD_WORDS:
                shards.append([])
                size = 0
            shards[-1].append((NONE - 1 if x.id is None else x.id, x.piece))
            size += x.n
        if shards[0]:
            yield shards


_BUILT: dict = {}


def automata(key: str, shards: list[list[tuple[int, str]]]) -> list[tuple[SuffixAutomaton, dict[str, int]]]:
    """The automata of a round's shards with their numbers of words; a worker process holds one round's."""
    if key not in _BUILT:
        _BUILT.clear()
        built = []
        for shard in shards:
            number: dict[str, int] = {}
            ref = SuffixAutomaton()
            for i, piece in shard:
                ref.add([number.setdefault(w, len(number)) for w in piece.split(" ")], i)
            ref.finish()
            built.append((ref, number))
        _BUILT[key] = built
    return _BUILT[key]


def reference_hits(docs: DataFrame, reference: DataFrame, smaller: bool = False) -> DataFrame:
    """(doc_id, th, starts): the windows of each document that stand in ``reference`` (doc_id, text), or there in a text with a smaller doc_id; th is a hash of the text.

    The reference goes out in rounds of broadcast shards, whose size is checked, and every document is streamed through each shard's automaton: matching
    statistics tell the longest match that ends at each word. Cost is documents times shards, so this is for references that don't grow with the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    pieces = written(reference_pieces(reference), "pieces")
    out = None
    for r, shards in enumerate(rounds(pieces)):
        shared, key = docs.sparkSession.sparkContext.broadcast(shards), f"{id(pieces)}-{r}-{sum(map(len, shards))}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            built = automata(key, shared.value)
            for b in slices(batches):
                starts = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = (t.as_py() or "").encode().split()
                    own = NONE if not smaller else -NONE if i is None else i
                    found: set[int] = set()
                    if len(words) >= WINDOW:
                        text = b" ".join(words).decode().split(" ")
                        for ref, number in built:
                            found.update(k for k, x in enumerate(ref.matches([number.get(w, -1) for w in text], WINDOW)) if x < own)
                    starts.append(sorted(found))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(starts, pa.list_(pa.int64()))], ["doc_id", "th", "starts"]).filter(pa.array([bool(x) for x in starts], pa.bool_()))

        one = written(rows.select("doc_id", "text", "th").mapInArrow(run, "doc_id long, th long, starts array<long>"), "round")
        shared.unpersist()
        out = one if out is None else out.union(one)
    if out is None:
        return rows.select("doc_id", "th", F.array().cast("array<long>").alias("starts")).limit(0)
    return out.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("starts")).alias("starts"))  # at most a text's own windows


def without_reference(docs: DataFrame, reference: DataFrame, smaller: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of ``docs``, without the spans of 50 words and more that stand in ``reference`` (doc_id, text).

    With ``smaller`` only reference texts with a smaller doc_id count; rows without a doc_id then lose nothing and are no reference. Null texts have no words; rows that repeat lose the same;
    empty tables give an empty result, or nothing removed; other columns are ignored.
    """
    hits = reference_hits(docs, reference, smaller)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__th"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(hits, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("th")), "left")
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return finished(joined.select(F.col("__id").alias("doc_id"), n_words.alias("n_words"), "text", "starts"), True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; nulls and odd rows as in ``substring_dedup``."""
    return substring_dedup(documents(spark, sf_dir), with_text=False)


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS dup FROM h),
g AS (SELECT doc_id, list(i) AS cut FROM m WHERE dup GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(cut, lambda i: range(i, i + 50)))) AS gone FROM g),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
r AS (SELECT doc_id, unnest(gone) AS i, TRUE AS r FROM c),
k AS (SELECT e.doc_id, count(r.r) AS n_removed, string_agg(x, ' ' ORDER BY e.i) FILTER (r.r IS NULL) AS kept FROM e LEFT JOIN r USING (doc_id, i) GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

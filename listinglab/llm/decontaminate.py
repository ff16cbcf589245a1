"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton's letters are words. Training words stream through it; at each place it knows
the longest suffix of what was read that stands in some item, so every window of an item that
occurs is seen when its last word is read.
"""

import hashlib
import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import stored, tidy
from .common import utf8

# A-Z become a-z; digits, letters and bytes above 0x7F are words, all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_READ = 1 << 16  # bytes of a text that are parted into words at a time
_SENT = 1 << 20  # bytes of texts that a task gathers before it sends its results on


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        cut = folded.find(b" ", at + _READ)
        cut = len(folded) if cut < 0 else cut
        yield folded[at:cut].split()
        at = cut


class Automaton:
    """Suffix automaton of several word sequences: all windows of `window` words of an item,
    and whole items of fewer, are known by state.

    States are numbers; arrays hold their suffix link, length and first edge, `more` the edges
    of states with several. So a word of an item takes about a hundred bytes."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.window, self.items = window, [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        ids = [array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for _, words in items]
        for seq in ids:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        # The state of each state's last `window` words, or 0; parents come first.
        self.at_window = array("i", [0]) * len(self.to)
        self.short = array("i", [-1]) * len(self.to)
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for s in order[1:]:
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[self.link[s]] < window else self.at_window[self.link[s]]
        pairs, self.whole = array("q"), {}
        for item, seq in enumerate(ids):
            state = 0
            for i, w in enumerate(seq):
                state = self.next(state, w)
                if i + 1 >= window:
                    pairs.append(self.at_window[state] << 32 | item)
            if 0 < len(seq) < window:
                self.whole.setdefault(state, []).append(item)
        held = np.unique(np.frombuffer(pairs, np.int64)) if pairs else np.empty(0, np.int64)
        self.starts = array("i", np.searchsorted(held >> 32, np.arange(len(self.to) + 1)).astype(np.int32).tobytes())
        self.held = array("i", (held & 0xFFFFFFFF).astype(np.int32).tobytes())
        # The nearest state at or above each one where a short item ends.
        for s in order:
            self.short[s] = s if s in self.whole else self.short[self.link[s]] if s else -1

    def next(self, state: int, w: int) -> int:
        """The state after one more word; -1 if no item goes on so."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def _put(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _new(self, length: int, link: int) -> int:
        for column, value in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.to) - 1

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        q = self.next(last, w)
        if q >= 0 and length[q] == length[last] + 1:
            return q
        cur = self._new(length[last] + 1, 0) if q < 0 else -1
        p = last
        while p >= 0 and (q := self.next(p, w)) < 0:
            self._put(p, w, cur)
            p = link[p]
        if p < 0:
            return cur
        if length[q] > length[p] + 1:
            copy = self._new(length[p] + 1, link[q])
            self.word[copy], self.to[copy] = self.word[q], self.to[q]
            if q in self.more:
                self.more[copy] = dict(self.more[q])
            link[q] = copy
            at = p
            while at >= 0 and self.next(at, w) == q:
                self._put(at, w, copy)
                at = link[at]
            q = copy
        if cur < 0:
            return q
        link[cur] = q
        return cur

    def scan(self, text: bytes) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans of a text's words, as ordered disjoint [start, end), the places of the
        items found, and the number of words."""
        vocab, word, to, more, link, length, short, window = self.vocab, self.word, self.to, self.more, self.link, self.length, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set = set()
        state = size = i = 0
        for words in words_of(text):
            for w in map(vocab.get, words):
                i += 1
                if w is None:
                    state = size = 0
                    continue
                while True:
                    if word[state] == w:
                        then = to[state]
                        break
                    then = more[state].get(w, -1) if state in more else -1
                    if then >= 0 or not state:
                        break
                    state = link[state]
                    size = length[state]
                if then < 0:
                    continue
                state = then
                size += 1
                hit = 0
                if size >= window:
                    s = self.at_window[state]
                    found.update(self.held[self.starts[s] : self.starts[s + 1]])
                    hit = window
                s = short[state]
                if s == state and size < length[s]:
                    s = short[link[s]]
                while s > 0:
                    found.update(self.whole[s])
                    hit = max(hit, length[s])
                    s = short[link[s]]
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found, i


def _pieces(text: bytes, window: int, most: int) -> Iterator[list[bytes]]:
    """The words of an item in pieces of at most `most` and window - 1 words: each window lies
    in one of them."""
    held: list[bytes] = []
    for words in words_of(text):
        held += words
        while len(held) >= most + window:
            yield held[: most + window - 1]
            held = held[most:]
    if held:
        yield held


def automata(items: DataFrame, window: int, most_bytes: int, piece: int = 10_000) -> tuple[DataFrame, int]:
    """(shard, automaton) for items dealt into shards of about `most_bytes` of text, and the
    number of shards. Long items are dealt in overlapping pieces. Each automaton is built once,
    by the task that its shard's pieces were shuffled to."""
    with tidy(items.sparkSession):
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // most_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in enumerate(batch.column("b")):
                for words in _pieces(b.as_py(), window, piece):
                    text = b" ".join(words)
                    shard = int.from_bytes(hashlib.md5(text).digest()[:7]) % shards
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(k, 1), pa.array([shard], pa.int64()), pa.array([text], pa.binary())], names=["item_id", "shard", "b"])

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["b"].to_pylist(), table["item_id"].to_pylist(), strict=True), key=str)
        made = Automaton([(i, b.split()) for b, i in rows], window)
        return pa.table({"shard": table["shard"][:1], "automaton": pa.array([pickle.dumps(vars(made))], pa.binary())})

    pieces = items.select("item_id", utf8("text").alias("b")).mapInArrow(deal, f"item_id {items.schema['item_id'].dataType.simpleString()}, shard long, b binary")
    return stored(pieces.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata"), shards


def _loaded(state: bytes) -> Automaton:
    auto = object.__new__(Automaton)
    vars(auto).update(pickle.loads(state))
    return auto


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, most_bytes: int = 2 << 20, cover: float | None = None) -> DataFrame:
    """Benchmark words in each row's whole text.

    Returns doc_id, n_words, n_hit, items (the item ids found, distinct), items_sha256, spans
    (array of [first word, end word)), and, if `cover` is given, every column of `docs` with
    `text` cleaned: hit spans are removed with what stands between their words, and `keep` is
    false for rows whose hit words are more than `cover` of all words, or all.

    A word is hit if it stands in an occurrence of a window: `window` item words in a row, or
    a whole item that has fewer (but some). Items without an id hit, but aren't listed. Null or
    empty texts and items have no words. Repeated rows are judged each. An empty benchmark hits
    nothing.

    A benchmark of up to `most_bytes` is one automaton, which is broadcast; training text is
    read where it lies, text by text, and nothing is shuffled. A larger one has an automaton
    for each shard of that size: one pass over the texts for each shard, with only that shard's
    automaton in any process, finds the texts it hits; hits are then summed by text and joined
    to the rows."""
    spark = docs.sparkSession
    whole, item_kind = cover is not None, items.schema["item_id"].dataType
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "items_sha256", "spans", "keep")] if whole else ["doc_id"]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    schema = f"{kinds}n_words long, n_hit long, items array<{item_kind.simpleString()}>, items_sha256 string, spans array<array<long>>" + ", keep boolean" * whole
    arrow_kind = pa.list_(to_arrow_type(item_kind))
    built, shards = automata(items, window, most_bytes)

    def reported(batches: Iterator[pa.RecordBatch], hits) -> Iterator[pa.RecordBatch]:
        """The result's rows; `hits` gives spans, items and words of the text at a place."""
        for batch in batches:
            out, first, held, text = [], 0, 0, batch.column("text").cast(pa.binary())

            def sent(upto: int, batch=batch) -> pa.RecordBatch:
                spans, ids, n, cleaned = zip(*out, strict=True)  # noqa: B023
                hit = [sum(b - a for a, b in s) for s in spans]
                part = batch.slice(first, upto - first)  # noqa: B023
                cols = {c: part.column(c) for c in own}
                cols |= {
                    "n_words": pa.array(n, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()),
                    "items": pa.array(ids, arrow_kind),
                    "items_sha256": pa.array([hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]),
                    "spans": pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int64()))),
                }
                if whole:
                    cols |= {"keep": pa.array([h <= cover * w and (not h or h < w) for h, w in zip(hit, n, strict=True)]), "text": pa.array(cleaned, pa.string())}
                return pa.RecordBatch.from_pydict(cols)

            for k in range(batch.num_rows):
                b = text[k].as_py()
                spans, ids, n = hits(batch, k, b or b"")
                out.append((spans, sorted(set(ids) - {None}, key=str), n, None if b is None or not whole else _without(b, spans)))
                held += len(b or b"")
                if held > _SENT:
                    yield sent(k + 1)
                    out, first, held = [], k + 1, 0
            if out:
                yield sent(batch.num_rows)

    if shards == 1:
        state = spark.sparkContext.broadcast((built.first() or [0, None])[1])  # of at most `most_bytes` of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _loaded(state.value) if state.value is not None else Automaton([], window)

            def hits(batch: pa.RecordBatch, k: int, text: bytes) -> tuple[list, list, int]:
                spans, found, n = auto.scan(text)
                return spans, [auto.items[i] for i in found], n

            return reported(batches, hits)

        return docs.select(*own, *({"text"} - {*own})).mapInArrow(run, schema)

    text_key = F.md5(utf8("text")).alias("__k")
    found = None
    for shard in range(shards):
        row = built.where(F.col("shard") == shard).first()
        if row is None:
            continue
        state = spark.sparkContext.broadcast(bytes(row["automaton"]))

        def pick(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            auto = _loaded(state.value)
            for batch in batches:
                for k, b in enumerate(batch.column("b")):
                    spans, places, _ = auto.scan(b.as_py())
                    if spans:
                        yield pa.RecordBatch.from_arrays([batch.column("__k").slice(k, 1), pa.array([[list(x) for x in spans]], pa.list_(pa.list_(pa.int64()))), pa.array([[auto.items[i] for i in places]], arrow_kind)], names=["__k", "__s", "__i"])

        part = docs.select(text_key, utf8("text").alias("b")).mapInArrow(pick, f"__k string, __s array<array<long>>, __i array<{item_kind.simpleString()}>")
        part = stored(part.groupBy("__k").agg(F.first("__s").alias("__s"), F.first("__i").alias("__i")), "hits")  # equal texts are hit alike
        state.destroy()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("__k").agg(F.flatten(F.collect_list("__s")).alias("__s"), F.flatten(F.collect_list("__i")).alias("__i"))  # a row of each shard at most

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hits(batch: pa.RecordBatch, k: int, text: bytes) -> tuple[list, list, int]:
            spans, ids = (batch.column(c)[k].as_py() or [] for c in ("__s", "__i"))
            return _joined([tuple(x) for x in spans]), ids, sum(map(len, words_of(text)))

        return reported(batches, hits)

    rows = docs.select(*own, *({"text"} - {*own}), text_key)
    return rows.join(found, "__k", "left").mapInArrow(finish, schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` and what stands between them."""
    if not spans:
        return text.decode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, cover: float = 0.5) -> DataFrame:
    """`docs` without benchmark text: spans of item windows are cut out of the texts, rows of
    which they are more than `cover` are left out, n_chars follows the text. Other rows stay
    as they are, nulls and empty texts too."""
    hidden = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c != "text"}  # no name clashes with a result's
    kept = find_leaks(docs.withColumnsRenamed(hidden), items, window, cover=cover).where("keep")
    out = {c: F.col(hidden.get(c, c)) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[v.alias(c) for c, v in out.items()])

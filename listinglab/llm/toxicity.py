"""Toxicity: a logistic classifier whose scores must not move when identity terms are swapped.

Features are the words of a whole text and their beginnings, as present or not. Training
minimises log loss plus `swap_weight` times the mean squared change of the log-odds of labelled
texts' sentences when every identity term in them is replaced by another of its group.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored, tidy
from .common import utf8

# Terms for groups of people; those of one line stand for each other. Words of a
# text are looked up without case and accents.
IDENTITY_TERMS = [
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "black white asian latino african european arab indian",
    "blacks whites asians latinos africans europeans arabs indians",
    "gay lesbian straight bisexual transgender heterosexual homosexual queer",
    "gays lesbians bisexuals heterosexuals homosexuals",
    "woman man girl boy",
    "women men girls boys",
    "female male",
    "immigrant refugee foreigner native",
    "immigrants refugees foreigners natives",
    "musulman chrétien juif bouddhiste athée hindou",
    "musulmane chrétienne juive athéiste hindoue",
    "musulmans chrétiens juifs bouddhistes athées hindous",
    "noir blanc asiatique arabe",
    "noirs blancs asiatiques arabes",
    "femme homme fille garçon",
    "femmes hommes filles garçons",
    "immigré réfugié étranger",
    "immigrés réfugiés étrangers",
    "muslimisch christlich jüdisch hinduistisch buddhistisch atheistisch",
    "muslimische christliche jüdische hinduistische buddhistische atheistische",
    "muslime christen juden hindus buddhisten atheisten",
    "frau mann mädchen junge",
    "frauen männer jungen",
    "einwanderer flüchtling ausländer",
    "musulmán cristiano judío budista ateo",
    "musulmana cristiana judía atea",
    "musulmanes cristianos judíos budistas ateos",
    "negro blanco asiático árabe",
    "mujer hombre chica chico niña niño",
    "mujeres hombres chicas chicos niñas niños",
    "inmigrante refugiado extranjero",
]
_SENTENCE = re.compile(rb"[.!?\n]+")
# A-Z become a-z; digits, letters and bytes above 0x7F are words, all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_HELD = 1 << 16  # words without a feature that a task remembers


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The whole word and its first 4, 5 and 6 bytes."""
    return (word + b"$", *(word[:n] for n in (4, 5, 6) if len(word) > n))


class Swaps:
    """The next term of its line for each identity term."""

    def __init__(self, terms: list[str]) -> None:
        self.next: dict[bytes, bytes] = {}
        self.seen: dict[bytes, bytes] = {}
        for line in terms:
            w = line.split()
            for a, b in zip(w, w[1:] + w[:1], strict=True):
                self.next.setdefault(self.folded(a.lower().encode()), b.lower().encode())

    def folded(self, word: bytes) -> bytes:
        """`word` without accents."""
        if word.isascii():
            return word
        if word not in self.seen:
            if len(self.seen) > _HELD:
                self.seen.clear()
            plain = unicodedata.normalize("NFKD", word.decode("utf-8", "replace").lower()).encode("ascii", "ignore")
            self.seen[word] = plain or word
        return self.seen[word]

    def sentences(self, text: bytes) -> Iterator[tuple[set[bytes], set[bytes]]]:
        """The words of each sentence that holds a term, as they stand and with terms swapped."""
        for part in _SENTENCE.split(text):
            words = words_of(part)
            found = {w: self.next[f] for w in words if (f := self.folded(w)) in self.next}
            if found:
                yield words, {found.get(w, w) for w in words}


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Weights by feature and a bias; `known` is false if there was nothing to learn from.
    `terms`: the groups whose terms were swapped in training, `swapped`: in how many sentences."""

    def __init__(self, weights: dict[bytes, float], bias: float, known: bool = True, terms: list[str] | None = None, swapped: int = 0) -> None:
        self.weights, self.bias, self.known, self.terms, self.swapped = weights, bias, known, terms or [], swapped

    def score(self, df: DataFrame, text: str = "text", to: str = "score") -> DataFrame:
        """`df` with the score of its whole texts in the column `to` (0 to 1), which replaces
        one of that name."""
        weights, bias, known = df.sparkSession.sparkContext.broadcast(self.weights), self.bias, self.known
        own = [c for c in df.columns if c != to]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, dull = weights.value, set()
            for batch in batches:
                scores = []
                for b in batch.column(text).cast(pa.binary()):
                    found: set[bytes] = set()
                    for word in words_of(b.as_py() or b"") - dull:
                        if hit := [f for f in features_of(word) if f in w]:
                            found.update(hit)
                        elif len(dull) < _HELD:
                            dull.add(word)
                    z = bias + sum(map(w.__getitem__, sorted(found)))
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if known else 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(scores, pa.float64())], names=[*own, to])

        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in own)
        return df.select(*own).mapInArrow(run, f"{kinds}`{to}` double")


def mined_groups(sample: DataFrame, counts: DataFrame, n: int, p: int, most_terms: int = 512) -> list[str]:
    """Groups of words that could stand for each other in `sample` (y, b): frequent words on
    which the label does not depend (chi-square at the level of 5 %), those that follow the same
    word most often in one group. `counts` are the sample's features (see `train`)."""
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    free = counts.where((F.col("a") + F.col("c") >= max(20, n // 100)) & (_chi(a, c, n, p) < 3.84)).where("substr(f, -1) = binary('$')")
    with tidy(sample.sparkSession):
        words = {bytes(r["f"])[:-1] for r in free.orderBy(F.desc(F.col("a") + F.col("c")), "f").limit(most_terms).collect()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for b in batch.column("b").to_pylist():
                w = b.translate(_FOLD).split()
                seen.update((x, y) for x, y in zip(w, w[1:]) if y in words)  # noqa: B905
        rows = list(seen.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"before": pa.array([k[0] for k, _ in part], pa.binary()), "word": pa.array([k[1] for k, _ in part], pa.binary()), "m": pa.array([m for _, m in part], pa.int64())})

    met = sample.select("b").mapInArrow(contexts, "before binary, word binary, m long").groupBy("word", "before").agg(F.sum("m").alias("m"))
    with tidy(sample.sparkSession):
        best = met.groupBy("word").agg(F.max(F.struct("m", "before")).alias("t")).select("word", "t.before").collect()  # `most_terms` at most
    groups: dict[bytes, list[bytes]] = {}
    for r in sorted(best):
        groups.setdefault(bytes(r["before"]), []).append(bytes(r["word"]))
    return [b" ".join(g).decode("utf-8", "replace") for _, g in sorted(groups.items()) if len(g) > 1]


def _chi(a: Column, c: Column, n: int, p: int) -> Column:
    """Chi-square of a feature in `a` of p positive rows and `c` of the n - p others."""
    q = n - p
    b, d = p - a, q - c
    return n * F.pow(a * d - b * c, 2) / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1.0))


def train(labelled: DataFrame, max_features: int = 4096, least_chi: float = 24.0, rounds: int = 30, swap_weight: float = 1.0, l2: float = 1e-4, terms: list[str] = IDENTITY_TERMS, mine: bool = False) -> Model:
    """A model from `labelled` (text, toxic 0/1; rows with a null label are left out), a sample
    of bounded size. Features are kept if five rows have them and the label depends on them
    (chi-square above `least_chi`, so that chance seldom picks one among a million), at most
    `max_features` by it. Weights start at each feature's own log-odds, those of identity terms
    at 0. Each round is one pass of Spark over the sample that sums gradients by partition; the
    driver holds one number for each feature.

    `terms`: groups of identity terms, one a line. mine: whether groups are mined from the sample
    too (see `mined_groups`), for languages that `terms` doesn't know. No rows: every score is 0. One label only: nothing depends on it, scores
    are its rate."""
    spark = labelled.sparkSession
    sample = stored(labelled.where("toxic is not null").select(F.col("toxic").cast("int").alias("y"), utf8("text").alias("b")), "sample")
    n, p = sample.agg(F.count("*"), F.sum("y")).first()
    if not n:
        dropped(sample)
        return Model({}, 0.0, known=False)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for y, b in zip(batch.column("y").to_pylist(), batch.column("b").to_pylist(), strict=True):
                (pos if y else neg).update({f for w in words_of(b) for f in features_of(w)})
        keys = list(pos.keys() | neg.keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"f": pa.array(part, pa.binary()), "a": pa.array([pos[k] for k in part], pa.int64()), "c": pa.array([neg[k] for k in part], pa.int64())})

    counts = stored(sample.mapInArrow(tally, "f binary, a long, c long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).where("a + c >= 5"), "counts")
    q = n - p
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    odds = F.log((a + 0.5) / (p + 1)) - F.log((c + 0.5) / (q + 1))
    with tidy(spark):
        top = counts.select("f", _chi(a, c, n, p).alias("chi"), odds.alias("odds")).where(F.col("chi") > least_chi).orderBy(F.desc("chi"), "f").limit(max_features).collect()
    names = [bytes(r["f"]) for r in top]
    index, size = {f: i for i, f in enumerate(names)}, len(names) + 1

    def encoded(terms: list[str]) -> tuple[DataFrame, int]:
        """Rows (y, x, s): of texts the label and features; of sentences with a term, without
        label, features as they stand and with terms swapped. And how many sentences those are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            swaps = Swaps(terms)
            there = lambda ws: sorted({index[f] for w in ws for f in features_of(w) if f in index})
            for batch in batches:
                ys, xs, ss = [], [], []
                for y, b in zip(batch.column("y").to_pylist(), batch.column("b").to_pylist(), strict=True):
                    rows = [(y, there(words_of(b)), []), *((None, there(w), there(t)) for w, t in swaps.sentences(b))]
                    for out, col in zip((ys, xs, ss), zip(*rows, strict=True), strict=True):
                        out += col
                yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "x": pa.array(xs, pa.list_(pa.int32())), "s": pa.array(ss, pa.list_(pa.int32()))})

        out = stored(sample.mapInArrow(run, "y int, x array<int>, s array<int>"), "encoded")
        return out, out.where("y is null").count()

    still = {f for t in terms for w in t.split() for f in features_of(w.encode())}
    if swap_weight and mine:
        mined = mined_groups(sample, counts, n, p)
        still |= {w.encode() + b"$" for t in mined for w in t.split()}
        terms = [*terms, *mined]
    rows, swapped = encoded(terms)
    data = rows.coalesce(8)

    def flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), col.flatten().to_numpy()

    def gradient(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(size)
            for batch in batches:
                (xr, xi), (sr, si) = flat(batch.column("x")), flat(batch.column("s"))
                text, m = batch.column("y").is_valid().to_numpy(zero_copy_only=False), batch.num_rows
                y = batch.column("y").fill_null(0).to_numpy()
                z = weights[-1] + np.bincount(xr, weights[xi], m)
                zs = weights[-1] + np.bincount(sr, weights[si], m)
                e = np.where(text, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0) / n
                moved = np.where(text, 0.0, 2 * swap_weight * (z - zs)) / max(1, swapped)
                g += np.bincount(xi, (e + moved)[xr], size) - np.bincount(si, moved[sr], size)
                g[-1] += e.sum()
            yield pa.RecordBatch.from_pydict({"g": pa.array([g.tobytes()], pa.binary())})

        return run

    w = np.append([0.0 if swap_weight and f in still else r["odds"] for f, r in zip(names, top, strict=True)], 0.0)
    w[-1] = np.log((p + 0.5) / (q + 0.5))
    first, second = np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        parts = data.mapInArrow(gradient(w), "g binary").collect()  # eight rows at most
        g = sum(np.frombuffer(r["g"]) for r in parts) + l2 * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    dropped(sample, counts, rows)
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]), True, terms, swapped)


def train_from(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, **options) -> Model:
    """A model from documents and their labels, without held-out rows (see `is_held_out`). A
    doc_id with several labels counts as toxic if one says so; of one with several texts the
    least is read.

    At most `max_rows` documents are learnt from, those of least hash of the id: the bound of
    this sample. Only ids are shuffled to find them; their texts are picked out in the scan."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    picked = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = stored(picked, "picked")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_rows ids
    model = train(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), **options)
    dropped(picked)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Each row of `docs` scored by a model of `labels`: doc_id, held_out, score, predicted
    (1 from `threshold` up). Null and empty texts get the score of no features; repeated rows
    are scored each; null ids are never learnt from; labels without documents are left out."""
    scored = train_from(docs, labels, **options).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; its columns stay as they are."""
    return train_from(docs, labels, **options).score(docs, to="__score").where(F.col("__score") < threshold).select(*docs.columns)

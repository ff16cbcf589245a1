"""Repair of conversations' turn structure by a parallel Viterbi search.

The cheapest edits that turn a conversation's rows into `(s?(ua)+)?` (system, then pairs of user
and assistant) are a shortest path: from every place and state of that pattern, a cost vector
holds what the rest of the conversation costs at least. Rows are range-sorted and cut into
chunks. Each chunk first works back from a guess of the vector at its right end (the true one
if it is its conversation's last); then chunks whose right neighbour found another vector run
again, back from their end as far as their vectors still change. Vectors that differ by a
constant only make the same choices, so only differences are kept and compared, and they are
soon those of any guess. Rows that are all deleted hand every vector on: lest rounds grow with
them, a pass hands vectors on within runs of 1, 2, 4, ... chunks.

Along the vectors the least audit is traced forward: of the edits that keep to the cheapest
cost, the least letter is the next. Chunks trace from all four states, which gives a function
of four values; these are composed by doubling, and tell in which state each chunk is entered.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored
from .common import small_batches

SPACE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
# States: nothing yet, after a system turn, after a user's, after an assistant's.
_STEP = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
_NEXT = (2, 2, 3, 2)  # the state that an inserted or rerolled turn leads to
_ROLE = ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs
END = bytes((0, 2 * INSERT, INSERT, 0))  # what is missing after the last row
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def remembered(f):
    """`f` with its results kept: there are few vectors. (A plain function goes to workers by value.)"""
    known: dict = {}

    def look(*key):
        if key not in known:
            known[key] = f(*key)
        return known[key]

    return look


@remembered
def costs(code: int, after: bytes) -> tuple[int, ...]:
    """What a row and all after it cost from each state; `after`: the vector behind the row."""
    who, fault = divmod(code, 4)
    own = UNFINISHED if fault == CUT else 0
    least = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if fault not in (BLANK, DUPLICATE):
            ways.append(REROLE + own + after[_NEXT[q]])
            if (q, who) in _STEP:
                ways.append(KEEP + own + after[_STEP[q, who]])
        least.append(min(ways))
    one = [least[_NEXT[q]] for q in range(4)]
    return tuple(min(least[q], INSERT + one[q], 2 * INSERT + one[_NEXT[q]]) for q in range(4))


@remembered
def before(code: int, after: bytes) -> bytes:
    """The vector before a row, less its least value."""
    v = costs(code, after)
    return bytes(x - min(v) for x in v)


@remembered
def edits(code: int, after: bytes, q: int) -> tuple[str, int, int, tuple[str, ...], str | None]:
    """The least cheapest edits of a row entered in state q: letters, cost, the state behind it,
    roles of inserted turns, and the row's role (None: deleted, "": its own)."""
    who, fault = divmod(code, 4)
    own, v = UNFINISHED if fault == CUT else 0, costs(code, after)
    letters, cost, new = "", 0, []
    while True:
        if DELETE + after[q] == v[q]:
            return letters + "D", cost + DELETE, q, tuple(new), None
        if INSERT + v[_NEXT[q]] == v[q]:
            letters, cost, new, q = letters + "I", cost + INSERT, [*new, _ROLE[q]], _NEXT[q]
        elif (q, who) in _STEP and own + after[_STEP[q, who]] == v[q]:
            return letters + "K", cost + KEEP + own, _STEP[q, who], tuple(new), ""
        else:
            return letters + "R", cost + REROLE + own, _NEXT[q], tuple(new), _ROLE[q]


def ending(q: int) -> tuple[str, ...]:
    """Roles of the turns to insert after the last row."""
    return ((), ("user", "assistant"), ("assistant",), ())[q]


def worked_back(codes: bytes, end: bytes, old: bytes | None = None) -> bytes:
    """Vectors before each row, four bytes each, from the one behind the last row. With the old
    ones, only rows whose vectors change are worked on."""
    out, v = bytearray(old or bytes(4 * len(codes))), end
    for i in range(len(codes) - 1, -1, -1):
        v = before(codes[i], v)
        if old and old[4 * i : 4 * i + 4] == v:
            break
        out[4 * i : 4 * i + 4] = v
    return bytes(out)


def behind(vectors: bytes, end: bytes) -> list[bytes]:
    return [*(vectors[k : k + 4] for k in range(4, len(vectors), 4)), end][: len(vectors) // 4]


# -- workers ---------------------------------------------------------------------------------

_CHUNK = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("codes", pa.binary()), ("at", pa.list_(pa.int32())), ("firsts", pa.list_(pa.binary())), ("lo", pa.int64()), ("hi", pa.int64()), ("fresh", pa.int64()), ("head", pa.int32()), ("tail", pa.int32())])
CHUNK = "conv_id long, block int, part int, roles array<string>, texts array<string>, codes binary, at array<int>, firsts array<binary>, lo long, hi long, fresh long, head int, tail int"


def _cutter(most_rows: int, most_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of sorted rows: of one conversation, at most `most_rows` rows, and no more
        once they hold `most_bytes`."""
        block, part = TaskContext.get().partitionId(), 0
        conv, begun, out, held = None, False, [], 0

        def new() -> None:
            nonlocal roles, texts, codes, at, firsts, seen, turns, size
            roles, texts, codes, at, firsts, seen, turns, size = [], [], bytearray(), [], [], set(), [], 0

        roles = texts = codes = at = firsts = seen = turns = size = None
        new()

        def close() -> None:
            nonlocal part, held
            out.append((conv, block, part, roles, texts, bytes(codes), at, firsts, turns[0] if turns else None, turns[-1] if turns else None, len(turns), codes[0] // 4 if codes else None, codes[-1] // 4 if codes else None))
            part, held = part + 1, held + size
            new()

        for batch in batches:
            for c, turn, role, text, n in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "n")), strict=True):
                if begun and c != conv:
                    close()
                conv, begun = c, True
                for _ in range(n):
                    if len(codes) >= most_rows or size >= most_bytes:
                        close()
                    bare = text.rstrip(SPACE)
                    fault = BLANK if not bare else FINE if bare[-1] in ".!?" else CUT
                    if fault != BLANK:
                        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                        if key in seen:
                            fault = DUPLICATE
                        else:
                            seen.add(key)
                            firsts.append(key)
                            at.append(len(codes))
                    who = "sua".find(role[0]) if role else -1
                    codes.append(4 * (who if who >= 0 else OTHER) + fault)
                    roles.append(role)
                    texts.append(text)
                    size += len(role) + len(text)
                    if turn is not None and (not turns or turn != turns[-1]):
                        turns.append(turn)
                if held > 4 << 20 or len(out) >= 1000:
                    yield _batch(out, _CHUNK)
                    out, held = [], 0
        if begun:
            close()
        yield _batch(out, _CHUNK)

    return cut


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_FOUND = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("codes", pa.binary()), ("vectors", pa.binary()), ("behind", pa.binary()), ("front", pa.binary()), ("exits", pa.list_(pa.int32())), ("moved", pa.bool_())])
FOUND = "block int, part int, codes binary, vectors binary, behind binary, front binary, exits array<int>, moved boolean"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works chunks back from a guess; rows of which an earlier chunk has a copy are marked."""
    for b in batches:
        out = []
        for block, part, codes, later in zip(*(b.column(k).to_pylist() for k in ("block", "part", "codes", "later")), strict=True):
            codes = bytearray(codes)
            for i in later or ():
                codes[i] = codes[i] // 4 * 4 + DUPLICATE
            out.append(_worked(block, part, bytes(codes), END, None))
        yield _batch(out, _FOUND)


def _worked(block: int, part: int, codes: bytes, end: bytes, old: bytes | None) -> tuple:
    vectors = worked_back(codes, end, old)
    front = vectors[:4] or end
    exits, after = list(range(4)), behind(vectors, end)
    for code, v in zip(codes, after, strict=True):
        exits = [edits(code, v, q)[2] for q in exits]
    return block, part, codes, vectors, end, front, exits, old is None or front != (old[:4] or None)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks whose right neighbour now begins with another vector run again. Rows come from
    right to left; `right` is null inside a run, where the row before tells."""
    last = None
    for b in batches:
        out = []
        for block, part, codes, vectors, end, front, exits, right in zip(*(b.column(k).to_pylist() for k in ("block", "part", "codes", "vectors", "behind", "front", "exits", "right")), strict=True):
            right = last if right is None else right
            if right == end:
                out.append((block, part, codes, vectors, end, front, exits, False))
            else:
                new = _worked(block, part, codes, right, vectors)
                out.append((*new[:-1], new[5] != front))
            last = out[-1][5]
        yield _batch(out, _FOUND)


_PIECE = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("parts", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), *[(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal", "lo", "hi", "fresh")]])
PIECE = "conv_id long, block int, part int, parts long, audit string, turns array<struct<role:string,text:string>>, cost long, blank long, duplicate long, truncated long, illegal long, lo long, hi long, fresh long"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, held = [], 0
        for conv, block, part, parts, last, q, roles, texts, codes, vectors, end, lo, hi, fresh, border in zip(*(b.column(k).to_pylist() for k in ("conv_id", "block", "part", "parts", "last", "entry", "roles", "texts", "codes", "vectors", "behind", "lo", "hi", "fresh", "border")), strict=True):
            audit, turns, cost = [], [], 0
            for code, v, role, text in zip(codes, behind(vectors, end), roles, texts, strict=True):
                letters, more, q, new, own = edits(code, v, q)
                audit.append(letters)
                cost += more
                turns.extend({"role": r, "text": ""} for r in new)
                if own is not None:
                    turns.append({"role": own or role, "text": text})
                    held += len(text)
            if last:
                turns.extend({"role": r, "text": ""} for r in ending(q))
                audit.append("I" * len(ending(q)))
                cost += INSERT * len(ending(q))
            faults = [c % 4 for c in codes]
            who = [c // 4 for c in codes]
            illegal = border + sum(p not in _LEGAL for p in zip(who, who[1:], strict=False))
            out.append((conv, block, part, parts, "".join(audit), turns, cost, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal, lo, hi, fresh))
            if held > 4 << 20:
                yield _batch(out, _PIECE)
                out, held = [], 0
        yield _batch(out, _PIECE)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose pieces (conv_id, lines, n) come in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])
    conv, begun, any_line, sha = None, False, False, None
    for b in batches:
        out = []
        for c, lines, n in zip(*(b.column(k).to_pylist() for k in ("conv_id", "lines", "n")), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, sha.hexdigest()))
                conv, begun, any_line, sha = c, True, False, hashlib.sha256()
            if n:
                sha.update((("\n" if any_line else "") + lines).encode())
                any_line = True
        yield _batch(out, schema)
    if begun:
        yield _batch([(conv, sha.hexdigest())], schema)


# -- the operator ----------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) damaged by crc32("conv_id:turn") % 20, nulls being one
    space: 0 drops a row (n = 0), 1 empties its text, 2 takes out `.!?`, 3 repeats it (n = 2), 4
    makes its role user."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def repair(turns: DataFrame, n: str | None = None, chunk_rows: int = 1024, chunk_bytes: int = 1 << 20, blocks: int | None = None) -> DataFrame:
    """The cheapest repair of `turns` (conv_id, turn, role, text), ties by the least audit.

    n: a column that tells how often each row stands there (0: the row is gone, but its
    conversation counts). Rows stand by turn, null first; ties by the first 64 characters of
    role, then of text, then by their hash. Null roles and texts are one space, a null conv_id is
    a conversation like others. A row's first fault is blank (nothing but white space),
    duplicate (role and text stand earlier in the conversation) or truncated (no `.!?` at the
    end). Keeping a row costs 0, another role 1, deleting 2 (blank and duplicate rows must go),
    inserting an empty turn 5; truncated rows that stay cost 5.

    Returns a row for each chunk, in the order of (block, part): conv_id, block, part, parts
    (chunks of its conversation), audit (the edits' initials), turns (the repaired ones, array
    of role and text), cost, blank, duplicate, truncated, illegal (neighbours that may not
    follow each other, the pair on the left border included), lo, hi and fresh (least and
    greatest turn, and how many distinct ones first stand in this chunk). A conversation none of
    whose rows remains has a chunk without turns; no rows give none.

    chunk_rows, chunk_bytes: a chunk ends once it has so many; `blocks`: partitions of the sort.
    A long conversation's rows lie in many blocks and chunks; what is gathered by conversation
    is a byte a row."""
    spark = turns.sparkSession
    as_text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", as_text("role"), as_text("text"), (F.col(n) if n else F.lit(1)).alias("n"))
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text")]
    ranged = rows.repartitionByRange(blocks, *order) if blocks else rows.repartitionByRange(*order)
    with small_batches(spark):
        chunks = stored(ranged.sortWithinPartitions(*order).mapInArrow(_cutter(chunk_rows, chunk_bytes), CHUNK), "chunks")
    conv = Window.partitionBy("conv_id").orderBy("block", "part")
    earlier = conv.rowsBetween(Window.unboundedPreceding, -1)
    legal = F.array(*[F.lit(10 * a + b) for a, b in sorted(_LEGAL)])
    left = F.last("tail", ignorenulls=True).over(earlier)
    places = chunks.select(
        "conv_id", "block", "part", "lo", "hi",
        (F.col("fresh") - F.coalesce((F.col("lo") == F.last("hi", ignorenulls=True).over(earlier)).cast("long"), F.lit(0))).alias("fresh"),
        F.coalesce((~F.array_contains(legal, 10 * left + F.col("head"))).cast("long"), F.lit(0)).alias("border"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("parts"),
        F.lead(F.lit(1)).over(conv).isNull().alias("last"),
    )
    places = stored(places, "places")
    several = stored(places.where("parts > 1").select("block", "part", "conv_id", (F.row_number().over(conv) - 1).alias("nth")), "several")
    # a row of which an earlier chunk of its conversation has a copy is a duplicate as well
    firsts = chunks.select("block", "part", F.explode(F.arrays_zip("at", "firsts")).alias("x")).join(several, ["block", "part"]).select("conv_id", "block", "part", "x.at", "x.firsts")
    nth = F.row_number().over(Window.partitionBy("conv_id", "firsts").orderBy("block", "part"))
    later = firsts.withColumn("nth", nth).where("nth > 1").groupBy("block", "part").agg(F.collect_list("at").alias("later"))
    found = stored(chunks.select("block", "part", "codes").join(later, ["block", "part"], "left").mapInArrow(_search, FOUND), "found")
    alone = found.join(several.select("block", "part"), ["block", "part"], "left_anti").withColumn("entry", F.lit(0))
    # fix-up passes, over chunks of conversations with several of them
    most = places.agg(F.max("parts")).first()[0] or 1
    now, run = stored(found.join(several, ["block", "part"]), "vectors"), 1
    while now.where("moved").take(1):
        shut = (F.col("nth") + 1) % run == 0  # a run's last chunk looks at the stored front behind it
        right = now.withColumn("right", F.when(shut | F.lead("nth").over(conv).isNull(), F.coalesce(F.lead("front").over(conv), F.lit(END))))
        right = right.withColumn("run", F.floor(F.col("nth") / run)).repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", F.desc("nth"))
        new = stored(right.mapInArrow(_again, FOUND).join(several, ["block", "part"]), "vectors")
        dropped(now)
        now, run = new, 2 * run
    # state behind each chunk by the state its conversation's first is entered in, by doubling
    state, step = stored(now.select("conv_id", "block", "part", "nth", "exits"), "states"), 1
    while step < most:
        back = F.lag("exits", step).over(conv)
        new = stored(state.withColumn("exits", F.when(back.isNull(), F.col("exits")).otherwise(F.transform(back, lambda q: F.element_at("exits", q + 1)))), "states")
        dropped(state)
        state, step = new, 2 * step
    states, state = state, state.select("block", "part", F.coalesce(F.lag("exits").over(conv)[0], F.lit(0)).alias("entry"))
    traced = now.join(state, ["block", "part"]).unionByName(alone, allowMissingColumns=True)
    traced = traced.select("block", "part", "codes", "vectors", "behind", "entry").join(places, ["block", "part"])
    with small_batches(spark, 100):
        pieces = stored(chunks.select("block", "part", "roles", "texts").join(traced, ["block", "part"]).mapInArrow(_trace, PIECE), "repaired")
    dropped(chunks, places, several, found, now, states)
    return pieces


def digests(pieces: DataFrame) -> DataFrame:
    """`repair`'s pieces put together: a row for each conversation, its repaired turns as a hash
    of `role:text` joined by newlines. Texts of a conversation of one piece stay where they are;
    the others' pass one task as a stream, for their hash is one value."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    counts = ["cost", "blank", "duplicate", "truncated", "illegal", "fresh"]
    own = pieces.select("conv_id", "block", "part", "audit", "lo", "hi", *counts, F.when(F.col("parts") == 1, F.sha2(lines, 256)).alias("sha"))
    parts = pieces.where("parts > 1").select("conv_id", "block", "part", lines.alias("lines"), F.size("turns").alias("n"))
    hashed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").select("conv_id", "lines", "n").mapInArrow(_hashes, "conv_id long, sha string")
    rows = own.unionByName(hashed, allowMissingColumns=True)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("block", "part", "audit")))), lambda x: x.audit), "")
    whole = rows.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in counts], F.min("lo").alias("lo"), F.max("hi").alias("hi"), audit.alias("audit"), F.max("sha").alias("repaired_sha256"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("fresh"), F.lit(0)).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

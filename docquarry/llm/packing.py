"""Best-fit packing of documents into fixed-length sequences by repeated patterns.

Documents become token pieces of at most the sequence length. What is planned is only the histogram of piece
lengths, whose size the sequence length bounds: patterns of a few lengths that fill a sequence are enumerated,
non-negative least squares fits how often each repeats, the counts are rounded, the same is done with what rounding left,
and the last few pieces are packed best fit on the histogram itself. Pieces then find their sequence by their rank within their length, in parallel.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, small_batches

LENGTH, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Word forms that a worker remembers, and pieces in one group when those of a length are numbered: by hash, or along an order.
REMEMBERED, GROUP_ROWS, TURN_ROWS = 500_000, 500, 20_000
#: Stretches of an order that are packed one after another: at most so many, of about so many sequences or more.
STRETCHES, STRETCH_SEQUENCES = 32, 64
#: Steps of the fit between two looks at its error.
STEADY = 25


_WORKERS: dict[str, WordIds] = {}


class WordIds:
    """Token ids of whole texts, word form by word form.

    The vocabulary's pre-tokenizer never joins across white space, nor a letter with a full stop or comma, so a
    text's ids are those of its forms in a row. A text of Latin-1 characters is lower-cased first, as the vocabulary
    would do, which halves the forms; others, and texts that may name a special token, are not touched. Arrow splits a batch
    of texts and tells its forms apart; each different form is looked up once a batch, and new ones are encoded together.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        (self.comma,) = self._encode(",").tolist()

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The one of this Python worker, so that later tasks know the forms of earlier ones."""
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def forms(texts: pa.Array) -> pa.ListArray:
        plain = pc.invert(pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[^\\x{00}-\\x{FF}]")))
        lower = pc.replace_substring_regex(pc.utf8_lower(texts), "([a-z])([.,])", r"\1 \2")
        return pc.ascii_split_whitespace(pc.if_else(plain, lower, texts))

    def _learn(self, forms: list[str]) -> None:
        fresh, apart = [], []
        for form in forms:
            if form in self.older:  # forms that are still in use come back from the older half
                self.known[form] = self.older[form]
            else:
                (apart if "," in form or "<|" in form else fresh).append(form)
        for k in range(0, len(fresh), 4096):  # in one text, with commas between that no form holds
            part = fresh[k : k + 4096]
            ids = self._encode(" , ".join(part))
            cuts = [-1, *np.flatnonzero(ids == self.comma).tolist(), len(ids)]
            for form, x, y in zip(part, cuts[:-1], cuts[1:], strict=True):
                self.known[form] = ids[x + 1 : y].tobytes()
        for form in apart:
            self.known[form] = self._encode(form).tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings) in a row, and where each text begins and the last ends."""
        split = self.forms(texts)
        words = split.flatten()
        coded = words.dictionary_encode()
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {"": b""}, self.known
        forms = coded.dictionary.to_pylist()
        self._learn([f for f in forms if f not in self.known])
        mine = list(map(self.known.__getitem__, forms))
        size = np.fromiter(map(len, mine), np.int64, len(mine)) // 4
        store, first = np.frombuffer(b"".join(mine), "<u4"), np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        each = size[at]
        after = np.concatenate(([0], np.cumsum(each)))
        ids = store[np.repeat(first[at] - after[:-1], each) + np.arange(after[-1])]
        return ids, after[split.offsets.to_numpy() - split.offsets[0].as_py()]


def _strings(bodies: pa.Array) -> pa.Array:
    """Bytes as strings; what is no UTF-8 becomes the replacement character."""
    try:
        return bodies.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in bodies.to_pylist()], pa.string())


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, turn_col: str | None = None) -> DataFrame:
    """doc, turn, piece, start, length, ids_crc32 of each piece (turn is 0 without turn_col): a document's ids and the end id, cut only where they exceed length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.of(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            if not len(batch):
                continue
            every, starts = ids(_strings(batch["body"]))
            every, owner, out = memoryview(every.tobytes()), [], []
            for n, (a, b) in enumerate(itertools.pairwise(starts.tolist())):
                for p, at in enumerate(range(0, b - a + 1, length)):
                    stop = min(at + length, b - a + 1)
                    crc = zlib.crc32(every[4 * (a + at) : 4 * min(a + stop, b)])
                    owner.append(n)
                    out.append((p, at, stop - at, zlib.crc32(end, crc) if a + stop > b else crc))
            columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(owner)) for c in ("doc", "turn")), *columns], ["doc", "turn", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc"), (F.col(turn_col) if turn_col else F.lit(0)).cast("long").alias("turn"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    return rows.mapInArrow(cut, f"doc {dict(rows.dtypes)['doc']}, turn long, piece int, start long, length long, ids_crc32 long")


def patterns(have: np.ndarray, length: int, each: int = 4) -> list[tuple[int, ...]]:
    """Patterns of few of the lengths that occur, sorted within each, that fill a sequence; exactly, where two more lengths can.

    Each length that occurs opens patterns with zero to each - 1 further documents, taken evenly over the histogram so that
    the patterns together resemble it. Then two lengths that fill the room exactly close it; where no two do, one more
    document is taken, and where none is left that fits, the pattern stays as it is.
    """
    sizes = np.flatnonzero(have)
    found: set[tuple[int, ...]] = set()
    if not len(sizes):
        return []
    listed, total, step = sizes.tolist(), np.cumsum(have[sizes]), 0
    there, twice = have > 0, have > 1

    def closing(room: int) -> tuple[int, ...] | None:
        if there[room]:
            return (room,)
        small = sizes[: bisect.bisect_right(listed, room // 2)]
        pairs = small[there[room - small]]
        if len(pairs) and 2 * pairs[-1] == room and not twice[room // 2]:
            pairs = pairs[:-1]
        if not len(pairs):
            return None
        one = int(pairs[int(step * 0.6180339887 % 1 * len(pairs))])
        return (one, room - one)

    for a in listed:
        for more in range(each):
            mine, room = [a], length - a
            while room >= listed[0]:
                step += 1
                if len(mine) > more and (end := closing(room)):
                    mine += end
                    break
                fits = bisect.bisect_right(listed, room) - 1
                one = listed[int(np.searchsorted(total[: fits + 1], step * 0.7548776662 % 1 * total[fits], "right"))]
                mine.append(one)
                room -= one
            found.add(tuple(sorted(mine)))
    return sorted(found)


def fit_counts(have: np.ndarray, made: list[tuple[int, ...]], length: int, rounds: int = 4000, still: float = 1e-4) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns whose total histogram is nearest to have: non-negative least squares.

    Multiplicative steps, which never raise the error, until STEADY of them lower it by less than a share of still. A length
    counts with its tokens, so that long ones are met first.
    """
    if not made:
        return np.zeros(0)
    col = np.repeat(np.arange(len(made)), [len(p) for p in made])
    row = np.concatenate([np.array(p) for p in made])
    heavy = np.arange(len(have)) / length
    goal = have * heavy
    pull = np.bincount(col, goal[row], len(made))
    x = np.full(len(made), goal.sum() / sum(map(sum, made)) * length)
    last = np.inf
    for k in range(rounds):
        now = np.bincount(row, x[col], len(have)) * heavy
        if k % STEADY == 0:
            error = float(((now - goal) ** 2).sum())
            if error > last * (1 - still):
                break
            last = error
        x *= pull / np.maximum(np.bincount(col, now[row], len(made)), 1e-300)
    return x


def fitted(have: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], np.ndarray]:
    """Patterns with whole repeat counts, and the histogram of what they leave.

    Fit, round, take; then again on what is left, as rounding leaves some of each length. Counts are rounded to the nearest
    whole number, in order of size, and at least to one while all the pattern's documents are there. Full patterns go first;
    ones that leave room are taken when full ones no longer bring anything, up to 1/256 of a sequence.
    """
    left, out, spare = have.astype(np.int64).copy(), [], 0
    while left.any():
        made = patterns(left, length)
        counts = fit_counts(left, made, length)
        before = len(out)
        tokens = int(left @ np.arange(len(left)))
        for k in np.argsort(-counts, kind="stable").tolist():
            if length - sum(made[k]) > spare:
                continue
            mine = Counter(made[k])
            n = min(max(1, int(counts[k] + 0.5)), min(int(left[s]) // t for s, t in mine.items()))
            if n > 0:
                for s, t in mine.items():
                    left[s] -= n * t
                out.append((tuple(mine.items()), n))
        if len(out) == before or int(left @ np.arange(len(left))) > 0.9 * tokens:
            if spare >= length // 256:
                break
            spare = min(length // 256, 4 * spare + 1)
    return out, left


def plan(have: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences as (((piece length, times), ...), repeats), covering the histogram have exactly: fitted patterns, then best fit."""
    out, left = fitted(have, length)
    sizes = [int(v) for v in np.flatnonzero(left)]
    while sizes:
        room, mine = length, {}
        while room >= sizes[0]:
            k = bisect.bisect_right(sizes, room) - 1
            while k >= 0 and left[sizes[k]] <= mine.get(sizes[k], 0):
                k -= 1
            if k < 0:
                break
            fits = min(room // sizes[k], int(left[sizes[k]]) - mine.get(sizes[k], 0))
            mine[sizes[k]] = mine.get(sizes[k], 0) + fits
            room -= fits * sizes[k]
        n = int(min(left[s] // t for s, t in mine.items()))
        for s, t in mine.items():
            left[s] -= n * t
            if not left[s]:
                del sizes[bisect.bisect_left(sizes, s)]
        out.append((tuple(sorted(mine.items(), reverse=True)), n))
    return out


_PLACE = ("key", "first", "times", "sequence", "offset", "size")


def places(planned: list, bins: int) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks within each length: key, first, times, sequence, offset. Sorted by key."""
    used = np.zeros(bins, np.int64)
    rows, sequence = [], 0
    for pattern, n in planned:
        offset = 0
        for size, times in pattern:
            rows.append((size << 44 | int(used[size]), int(used[size]), times, sequence, offset, size))
            used[size] += n * times
            offset += size * times
        sequence += n
    rows.sort()
    return dict(zip(_PLACE, np.array(rows, np.int64).reshape(-1, 6).T, strict=True))


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, turn_col: str | None = None) -> DataFrame:
    """doc, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row.

    turn_col names each row's place (0 or more, no two alike) in an order that the sequences are to follow: it is
    cut into up to STRETCHES stretches, which are packed one after another, and within a stretch the pieces of a length are taken in order.

    A null or empty text is one piece that holds the end id alone. Rows that repeat an identifier are packed one by
    one. Every sequence is filled without gaps from offset 0. An empty table gives an empty result.
    """
    spark = df.sparkSession
    cut = materialize(pieces(df, vocabulary, id_col, text_col, length, turn_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    seen = cut.agg(F.sum("length").alias("tokens"), F.max("turn").alias("last")).first()
    parts = max(1, min(STRETCHES, (seen["tokens"] or 0) // (length * STRETCH_SEQUENCES))) if turn_col else 1
    cut = cut.withColumn("part", F.floor(F.col("turn") * parts / ((seen["last"] or 0) + 1)).cast("long"))
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most parts * length rows
    have = np.zeros((parts, length + 1), np.int64)
    for r in counts:
        have[r["part"], r["length"]] = r["n"]

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, one in zip(b["part"].to_pylist(), b["have"].to_pylist(), strict=True):
                made = plan(np.frombuffer(one, np.int64), length)
                here = [places(made, length + 1)[c].tobytes() for c in _PLACE]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sum(n for _, n in made)]), *(pa.array([v], pa.binary()) for v in here)], ["part", "sequences", *_PLACE])

    tables = spark.createDataFrame([(k, bytearray(have[k].tobytes())) for k in range(parts)], "part long, have binary").repartition(parts, "part")
    plans = sorted(tables.mapInArrow(planned, ", ".join(["part long, sequences long", *(f"{c} binary" for c in _PLACE)])).collect())  # a few entries for each part and length
    found, sequences = [], 0
    for r in plans:
        here = {c: np.frombuffer(r[c], np.int64).copy() for c in _PLACE}
        here["key"] += r["part"] * (length + 1) << 44
        here["sequence"] += sequences
        sequences += r["sequences"]
        found.append(here)
    sent = spark.sparkContext.broadcast({c: np.concatenate([h[c] for h in found]) for c in _PLACE})
    if turn_col:
        dealt = cut.withColumn("grp", F.floor(F.col("turn") / TURN_ROWS))
    else:
        groups = spark.createDataFrame([(r["length"], -(-r["n"] // GROUP_ROWS)) for r in counts], "length long, groups long")
        dealt = cut.join(F.broadcast(groups), "length").withColumn("grp", F.pmod(F.xxhash64("uid"), F.col("groups")))  # rows that are alike in everything fall apart too
    keys = ["part", "length", "grp"]
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(*keys, (F.sum("size").over(Window.partitionBy("part", "length").orderBy("grp")) - F.col("size")).alias("before"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "doc", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("rn", number).join(before, keys).select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn")).alias("nth"), "part")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for b in batches:
            size, nth = b["length"].to_numpy() + b["part"].to_numpy() * (length + 1), b["nth"].to_numpy()
            k = np.searchsorted(at["key"], (size << 44) | nth, "right") - 1
            step = nth - at["first"][k]
            found = at["sequence"][k] + step // at["times"][k], at["offset"][k] + step % at["times"][k] * at["size"][k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *map(pa.array, found)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["doc"]
    return ranked.mapInArrow(placed, f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_vocabulary()).withColumnRenamed("doc", "doc_id")

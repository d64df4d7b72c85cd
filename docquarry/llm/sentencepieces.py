"""Encoding and decoding with SentencePiece models of merge type, exactly, by backtracking.

A sequence of pieces is the result of merging if, and only if, each two neighbours are: merging the characters of both together gives
those two again. So no queue of merges is run over a text. An Aho-Corasick automaton lists the pieces that begin at each
character; from the left the longest one is taken that is compatible with its predecessor, shorter ones after it, and
where none is, the last piece is given back and its end is marked in a bitfield as a place from which no way leads on. No
place is tried twice, so the work is linear in the text.

Merges never reach over two characters that no piece holds side by side. Texts are cut there, and short stretches between spaces are
remembered by the Python worker.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import named, small_batches

MODEL = "piece_bpe_32k.model"
SPACE, UNKNOWN_TEXT, NEVER = "▁", " ⁇ ", float("-inf")
#: Stretches and pairs that a worker remembers (two halves, of which the older goes), the longest such stretch, and characters that are split at a time.
REMEMBERED, PAIRS, FORM, SLICE = 400_000, 1_000_000, 64, 1 << 20
#: Marks that often follow a word; where no piece holds one behind a letter, words are remembered without them.
MARKS, LETTER = ",.;:!?", re.compile(r"[^\W\d_]")
#: Field numbers of the public model format: normalizer and trainer settings of the model, and those of their own fields that are read.
NORMALIZER, TRAINER, MODEL_TYPE, BPE, SUFFIX_SPACES = 3, 2, 3, 2, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5

_WORKERS: dict[str, MergePieces] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class MergePieces:
    """The vocabulary of a model, its automaton, and what a worker remembers of texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        top = dict(_fields(data))
        how, trained = dict(_fields(top.get(NORMALIZER, b""))), dict(_fields(top.get(TRAINER, b"")))
        plain = not how.get(CHARSMAP) and how.get(DUMMY_PREFIX, 1) == 1 and how.get(REMOVE_SPACES, 1) == 0 and how.get(ESCAPE_SPACES, 1) == 1
        if trained.get(MODEL_TYPE) != BPE or trained.get(SUFFIX_SPACES, 0) or not plain:
            raise ValueError("only merge models with the identity as normalizer and spaces before words are supported")
        read = sentencepiece.SentencePieceProcessor(model_proto=data)
        everything = range(len(read))
        if any(read.is_unused(k) for k in everything):
            raise ValueError("models with unused pieces are not supported")
        self.begin, self.end = read.bos_id(), read.eos_id()
        normal = {read.id_to_piece(k): k for k in everything if not (read.is_byte(k) or read.is_control(k) or read.is_unknown(k))}
        self.byte_ids = {int(read.id_to_piece(k)[1:-1], 16): k for k in everything if read.is_byte(k)}
        if len(self.byte_ids) != 256 or any(c not in normal for piece in normal for c in piece):
            raise ValueError("a model must have a piece for each byte and for each character of its pieces")
        self.ids, self.length = normal, {k: len(piece) for piece, k in normal.items()}
        self.scores = {piece: read.get_score(k) for piece, k in normal.items() if len(piece) > 1}
        self.text = {k: piece for piece, k in normal.items()}
        self.inside = {a + b for piece in normal for a, b in itertools.pairwise(piece)}
        self.singles = {piece for piece in normal if len(piece) == 1}
        self.tree = ahocorasick.Automaton()
        for piece, k in normal.items():
            if self.merge(piece) == [piece]:  # one that merging never makes is in no result
                self.tree.add_word(piece, k)
        self.tree.make_automaton()
        spaced = all(bigram[1] != SPACE or bigram[0] == SPACE for bigram in self.inside)
        lines = not any("\n" in bigram for bigram in self.inside)
        marks = re.escape("".join(c for c in MARKS if not any(b == c and LETTER.match(a) for a, b in self.inside)))
        words = rf" *[^\W\d_]+(?=[{marks}])|" if marks else ""
        self.stretches = re.compile(rf"{words}\n| *[^ \n]+| +" if spaced and lines else rf"{words} *[^ ]+| +" if spaced else r"(?s).+").findall
        self.cut = re.compile("[^ ] " if spaced else r"(?!)")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.surface = [b""] * len(read)
        for k, piece in self.text.items():
            self.surface[k] = piece.replace(SPACE, " ").encode()
        for byte, k in self.byte_ids.items():
            self.surface[k] = bytes([byte])
        self.surface[read.unk_id()] = UNKNOWN_TEXT.encode()
        self.are_bytes = set(self.byte_ids.values())
        self.control = {k for k in everything if read.is_control(k)}

    @classmethod
    def of(cls, path: str) -> MergePieces:
        """The one of this Python worker, so that later tasks know what earlier ones met."""
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def merge(self, text: str, wall: int = -1) -> list[str] | None:
        """Plain merging of a short text: the pair of the highest score, the leftmost of equal ones, until none is a piece. None if a merge reaches over the wall-th character."""
        parts, score = list(text), self.scores.get
        scores = [score(a + b, NEVER) for a, b in itertools.pairwise(parts)]
        while scores and (best := max(scores)) > NEVER:
            k = scores.index(best)
            if k + 1 == wall:
                return None
            wall -= k + 1 < wall
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], NEVER)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], NEVER)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both pieces' characters again gives these two pieces, of which each alone is what its own merge to."""
        found = self.pairs.get((left, right))
        if found is None:
            a, b = self.text[left], self.text[right]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = a[-1] + b[0] not in self.inside or self.merge(a + b, len(a)) is not None
        return found

    def backtrack(self, part: str) -> list[int]:
        """Ids of a stretch whose characters are all pieces."""
        n, length, pairs = len(part), self.length, self.pairs
        begins: list[list[int]] = [[] for _ in range(n)]  # ids of the pieces that begin there, longest last
        for last, k in self.tree.iter(part):
            begins[last + 1 - length[k]].append(k)
        failed = bytearray((n >> 3) + 1)
        taken: list[int] = []
        ranks: list[int] = []
        at, rank = 0, len(begins[0]) - 1
        last = None
        while at < n:
            here = begins[at]
            while rank >= 0:
                k = here[rank]
                to = at + length[k]
                if not failed[to >> 3] >> (to & 7) & 1 and (last is None or (pairs.get((last, k)) or (last, k) not in pairs and self.compatible(last, k))):
                    break
                rank -= 1
            if rank >= 0:
                taken.append(k)
                ranks.append(rank)
                last, at = k, to
                if to < n:
                    rank = len(begins[to]) - 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= length[taken.pop()]
                rank, last = ranks.pop() - 1, taken[-1] if taken else None
        return taken

    def _stretch(self, form: str) -> bytes:
        text, ids, first = form.replace(" ", SPACE), [], 0
        if len(text) <= FORM and self.singles.issuperset(text):  # no use in cutting it further
            ids = self.backtrack(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in self.inside:
                part = text[first:k]
                first = k
                if len(part) > 1:
                    ids += self.backtrack(part)
                elif part in self.ids:
                    ids.append(self.ids[part])
                else:
                    ids += map(self.byte_ids.__getitem__, part.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            found = self.cut.search(text, at + SLICE)
            to = found.start() + 1 if found else len(text)
            yield text[at:to]
            at = to

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers, with begin and end."""
        out = [struct.pack("<I", self.begin)]
        for part in self._slices(" " + text.replace(SPACE, " ") if text else ""):
            forms = self.stretches(part)
            for form in set(forms).difference(self.known):
                if form in self.older:
                    self.known[form] = self.older[form]
                elif len(form) <= FORM:
                    self.known[form] = self._stretch(form)
            known = self.known
            out.append(b"".join([known[f] if f in known else self._stretch(f) for f in forms]))
            if len(known) > REMEMBERED // 2:
                self.known, self.older = {}, known
        out.append(struct.pack("<I", self.end))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: spaces for their sign, the one before the first word gone, bytes put together; a byte that belongs to no character is U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.surface.__getitem__, numbers))
        first = next((k for k in numbers if k not in self.control), None)
        skip = int(first in self.text and self.text[first].startswith(SPACE))
        if self.control.isdisjoint(numbers[1:-1]):
            try:
                return raw[skip:].decode()
            except UnicodeDecodeError:
                pass
        parts = []
        for kind, run in itertools.groupby(numbers, key=lambda k: (k in self.are_bytes, k in self.control)):  # a character's bytes stand side by side
            here = b"".join(map(self.surface.__getitem__, run))
            parts.append(_characters(here) if kind[0] else here.decode())
        return "".join(parts)[skip:]


def _characters(data: bytes) -> str:
    """UTF-8 as text, each byte that belongs to no character as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc, ids (binary: little-endian unsigned 32-bit, begin and end included) of each row's whole text; with decoded also the text that the ids stand for.

    A null text is the empty text, whose ids are begin and end alone. Every row comes out once, whatever its identifier. What is no
    UTF-8 is read as U+FFFD. An empty table gives an empty result. Other columns of df are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = MergePieces.of(model)
        for b in batches:
            ids = [pieces.encode((x.as_py() or b"").decode("utf-8", "replace")) for x in b["body"]]
            columns = [b["doc"], pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(pieces.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    rows = df.select(named(id_col).alias("doc"), named(text_col).cast("binary").alias("body"))
    names = ["doc", "ids", "decoded"] if decoded else ["doc", "ids"]
    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, ids binary" + ", decoded string" * decoded)


def decode(df: DataFrame, model: str, id_col: str = "doc", ids_col: str = "ids") -> DataFrame:
    """doc, text of each row's ids (as encode gives them; null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = MergePieces.of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array([pieces.decode(x.as_py() or b"") for x in b["ids"]], pa.string())], ["doc", "text"])

    small_batches(df.sparkSession)
    rows = df.select(named(id_col).alias("doc"), named(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, default_model(), decoded=True)
    return coded.select(F.col("doc").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

"""SentencePiece encoding and decoding of whole texts by a Viterbi search over shared prefixes.

The given vocabulary is of the byte-pair kind: a text's pieces are those that merging by rank leaves, not the
ones of the largest score sum. So the search's transitions are the merges themselves: a step from one piece to the
next costs nothing if merging the two pieces' characters gives just these two again, and is ruled out
otherwise. One path through the lattice is left, the library's own ids; the tests compare them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bounds of a worker's memory: steps, bytes of remembered words, the longest of them, characters
#: encoded at a time, and bytes of texts in a batch that goes back.
_STEPS, _BYTES, _LONGEST, _FLUSH, _SLICE = 200_000, 24_000_000, 48, 1_000_000, 4_000_000
#: Bytes that a remembered word takes besides its characters and ids.
_ENTRY = 200
_SHIFT = 21


class Pieces:
    """The vocabulary, the lattice search, and the ids of the words met so far (up to a bound in bytes).

    In the search a piece is its id; a character that the vocabulary lacks is a number after all ids.
    """

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback:
            raise ValueError("made for byte-pair vocabularies with byte fallback and no normalization")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        usable = {kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in usable}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type in usable}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.names = [p.piece for p in model.pieces]
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode() if p.type in usable else b"" for p in model.pieces]
        self.longest = max(map(len, self.id))
        self.dummy = model.normalizer_spec.add_dummy_prefix
        self.steps: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """Merging by rank, for a few characters: the best neighbours first, the left ones among equals."""
        parts, rank, never = list(text), self.rank, float("inf")
        order = [rank.get(a + b, never) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        while order and (best := min(order)) < never:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank.get(parts[i - 1] + parts[i], never)
            if i < len(order):
                order[i] = rank.get(parts[i] + parts[i + 1], never)
        return parts

    def _name(self, piece: int) -> str:
        return self.names[piece] if piece < len(self.names) else chr(piece - len(self.names))

    def _step(self, last: int, piece: int) -> bool:
        """Whether ``piece`` can follow ``last``, or begin a word if that is negative; remembered in ``steps``."""
        own = self._name(piece)
        ok = len(own) == 1 or self.merged(own) == [own]
        if ok and last >= 0:
            before = self._name(last)
            ok = self.merged(before + own) == [before, own]
        if len(self.steps) >= _STEPS:
            self.steps.clear()
        self.steps[last + 1 << _SHIFT | piece] = ok
        return ok

    def search(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The pieces of each of the distinct words, in ascending order: a depth-first walk of their trie.

        ``starts[i]`` and ``lasts[i]`` are the surviving path's last piece for the first i characters. They depend on
        these alone, so what belongs to the prefix that a word shares with the one before is kept.
        """
        ids, steps, longest, lacking = self.id, self.steps, self.longest, len(self.names)
        before, starts, lasts = "", [0], [-1]
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del starts[shared + 1 :], lasts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    piece = ids.get(word[start:end])
                    if piece is None:
                        if start < end - 1:
                            continue
                        piece = lacking + ord(word[start])
                    last = lasts[start]
                    ok = steps.get(last + 1 << _SHIFT | piece)
                    if ok or ok is None and self._step(last, piece):
                        starts.append(start)
                        lasts.append(piece)
                        break
                else:
                    raise AssertionError(f"no path through {word!r}")
            path, at = [], len(word)
            while at:
                path.append(lasts[at])
                at = starts[at]
            path.reverse()
            yield word, path
            before = word

    def _ids(self, path: list[int]) -> bytes:
        lacking = len(self.names)
        if max(path) >= lacking:  # a character that the vocabulary lacks is its bytes
            path = [i for p in path for i in ([p] if p < lacking else [self.byte[b] for b in chr(p - lacking).encode("utf-8", "surrogatepass")])]
        return array("i", path).tobytes()

    def _marked(self, text: str) -> list[str]:
        """Runs of marks each with the characters up to the next mark; no piece reaches over their ends."""
        if not text:
            return []
        return _RUNS.findall((MARK if self.dummy else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids (little-endian signed 32-bit) of each text; null stays null.

        Words are remembered in two generations, each of at most ``_BYTES`` bytes: those met since the last one filled
        up, and that one; words that nobody asks for again fall out with the older.
        """
        split = [None if t is None else self._marked(t) for t in texts]
        if self.held > _BYTES:
            self.older, self.words, self.held = self.words, {}, 0
        new = {w for s in split if s for w in s} - self.words.keys()
        again = {w: self.older[w] for w in new & self.older.keys()}
        fresh = {w: self._ids(path) for w, path in self.search(new - again.keys())}
        self.words |= again
        self.words |= fresh
        out = [None if s is None else b"".join(map(self.words.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > _LONGEST:
                del self.words[w]
            else:
                self.held += len(w) + len(self.words[w]) + _ENTRY
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text: marks are spaces again, but for the one put before the text; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


@cache
def load(path: str) -> Pieces:
    """One for each Python worker and path."""
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(pieces: Pieces, texts: pa.Array) -> pa.Array:
    """The ids of each text, some ``_FLUSH`` characters at a time."""
    found, held, size = [], [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > _FLUSH or i == len(texts) - 1:
            found += pieces.encode(held)
            held, size = [], 0
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in found)]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(x or b"" for x in found), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in found], pa.bool_()))


def _decoded(pieces: Pieces, rows: pa.Array) -> pa.Array:
    """The text of each row of ids."""
    flat, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    whole = rows.is_valid().to_numpy(zero_copy_only=False).tolist()
    return pa.array((pieces.decode(flat[s:e].tolist()) if ok else None for ok, s, e in zip(whole, ends[:-1], ends[1:], strict=True)), pa.string())


def _slices(b: pa.RecordBatch, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most some ``_SLICE`` bytes of ``column``, so that a worker holds the results of one part only."""
    sizes = pc.binary_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column)
    bytes_before = np.cumsum([0, *pc.fill_null(sizes, 0).to_pylist()])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + _SLICE, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _mapped(rows: DataFrame, column: str, outs: list[tuple[str, str]], run, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` of each row and what ``run`` makes of ``column``, which goes to Python once if ``keep`` has it too."""
    source = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(dict.fromkeys([*keep, column]))])
    at, n = [*keep, column].index(column), len(keep)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in _slices(whole, whole.column(at)):
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *run(b.column(at))], [*b.schema.names[:n], *[f"y{i}" for i in range(len(outs))]])

    schema = ", ".join([*(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"y{i} {kind}" for i, (_, kind) in enumerate(outs))])
    got = source.mapInArrow(batches, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"y{i}").alias(c) for i, (c, _) in enumerate(outs)])


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` (array of ints) of each row: null for a null text, no ids for an empty one.

    Rows are independent of each other: repeated rows and keys, null keys and an empty table need nothing special,
    columns outside ``keep`` are dropped, so none can clash. A very long text is held whole, once, by one worker.
    """
    path = path or default_path()
    return _mapped(docs, text, [("ids", "array<int>")], lambda texts: [_encoded(load(path), texts)], keep)


def decode_documents(encoded: DataFrame, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``text`` of each row of ids; null for null, and otherwise as for ``encode_documents``."""
    path = path or default_path()
    return _mapped(encoded, ids, [("text", "string")], lambda rows: [_decoded(load(path), rows)], keep)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` and ``decoded`` of each row: the text's ids and what they decode to, by one worker a task.

    Null and empty texts, repeats, very long texts and clashing names as for ``encode_documents``.
    """
    path = path or default_path()

    def run(texts: pa.Array) -> list[pa.Array]:
        ids = _encoded(load(path), texts)
        return [ids, _decoded(load(path), ids)]

    return _mapped(docs, text, [("ids", "array<int>"), ("decoded", "string")], run, keep)


def op8_query(spark, sf_dir: str) -> DataFrame:
    """The ids of every document, and the SHA-256 of the text that they decode to."""
    back = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))

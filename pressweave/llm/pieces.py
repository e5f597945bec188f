"""Operator 9: exact encoding and decoding with a merge-type (BPE) piece vocabulary.

Longest matches come from an Aho-Corasick automaton over the pieces. A piece
is taken after its left neighbour only if merging the two pieces' characters
anew gives just these two; otherwise the next shorter match is tried, and a
position from which no piece fits is marked in a bitfield and left by
backtracking, so that each position fails at most once.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SPACE_MARK = "▁"
#: Score of a pair that is no piece.
NO_MERGE = float("-inf")
#: Entries kept of a process's caches of pairs of pieces, texts between cuts and parts, and the longest text that is kept. They bound the
#: memory of a Python worker, which keeps its caches after its tasks: a part takes some 300 bytes, and most texts between cuts come once.
PAIRS_KEPT, UNITS_KEPT, PARTS_KEPT, CACHE_LENGTH = 400_000, 40_000, 300_000, 64


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float, int], ...]:
    """(piece, score, kind) by id, kinds as in the model file: 1 normal, 2 unknown, 3 control, 6 byte."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("only merge-type models with byte fallback, a leading space and no normalisation are supported")
    if any(p.type == 4 for p in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    return tuple((p.piece, p.score, p.type) for p in model.pieces)


class _Made(dict):
    """A bounded cache of two generations: values are made on first use; when the young half is full, the old half goes. Texts over CACHE_LENGTH are made anew each time."""

    def __init__(self, make, entries: int):
        self.make, self.half, self.old = make, entries // 2, {}

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > CACHE_LENGTH:
            return self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Pieces:
    """Encoder and decoder of one vocabulary; holds caches, so keep one for each process."""

    def __init__(self, pieces: tuple[tuple[str, float, int], ...]):
        self.pieces = pieces
        self.score = {p: s for p, s, kind in pieces if kind == 1}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.last_byte = max(self.byte_id.values())
        if sorted(self.byte_id.values())[0] != self.last_byte - 255 or any(kind == 1 for _, _, kind in pieces[: self.last_byte]):
            raise ValueError("byte pieces must come first")
        self.bos, self.eos = (next(i for i, x in enumerate(pieces) if x[0] == name) for name in ("<s>", "</s>"))
        self.surface = [p.replace(SPACE_MARK, " ").encode() if kind == 1 else bytes([int(p[3:5], 16)]) if kind == 6 else b"" for p, _, kind in pieces]
        self.surface[next(i for i, x in enumerate(pieces) if x[2] == 2)] = " ⁇ ".encode()
        self.automaton = ahocorasick.Automaton()
        self.inside: set[str] = set()
        self.size = [len(x[0]) for x in pieces]
        self.known = frozenset(p for p in self.id if len(p) == 1)
        self.longest = max(map(len, self.id))
        for p, i in self.id.items():
            # a piece that no sequence of merges makes can't come up
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, i)
            self.inside.update(p[i : i + 2] for i in range(len(p) - 1))
        self.automaton.make_automaton()
        if any(c not in self.id for p in self.score for c in p):
            raise ValueError("every character of a piece must be a piece")
        #: The next shorter piece that starts like a piece, by id; -1: none.
        self.shorter = [next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if kind == 1 and p[:n] in self.automaton), -1) for p, _, kind in pieces]
        # a space mark after another character starts a piece in any such vocabulary; else texts stay in one part
        whole = any(b[1] == SPACE_MARK and b[0] != SPACE_MARK for b in self.inside)
        self.parts = re.compile("(?s).+" if whole else f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        self.grown = _Made(self._grown, 2 * len(pieces))
        self.fits = _Made(self._fits, PAIRS_KEPT)
        self.units = _Made(self.backtrack, UNITS_KEPT)
        self.done = _Made(self._part, PARTS_KEPT)

    def _fits(self, pair: int) -> bool:
        """Whether merging the characters of two pieces anew gives the two; pair: left id * number of pieces + right id."""
        left, right = divmod(pair, len(self.pieces))
        if self.pieces[left][0][-1] + self.pieces[right][0][0] not in self.inside:
            return True
        # until a merge crosses the border, each side grows as it does by itself, the side of the better next merge first
        (gains, _, lasts), (others, firsts, _), score = self.grown[left], self.grown[right], self.score
        i = j = 0
        while True:
            gain, other = gains[i], others[j]
            crossing = score.get(lasts[i] + firsts[j], NO_MERGE)
            if crossing > gain and crossing >= other:
                return False
            if gain == other == NO_MERGE:
                return True
            if gain >= other:
                i += 1
            else:
                j += 1

    def _grown(self, piece: int) -> tuple[tuple[float, ...], tuple[str, ...], tuple[str, ...]]:
        """How a piece grows from its characters: before each merge and at the end, the score of the next merge and the first and the last part."""
        steps: list[tuple[float, str, str]] = []
        self.merge(self.pieces[piece][0], lambda best, out: steps.append((best, sys.intern(out[0]), sys.intern(out[-1]))))
        return tuple(zip(*steps))

    def merge(self, text: str, watch: Callable[[float, list[str]], None] | None = None) -> list[str]:
        """The merge rule itself: join the adjacent pair of best score, leftmost first, while any pair is a piece; watch sees each step's score and parts."""
        out, score = list(text), self.score
        gains = [score.get(a + b, NO_MERGE) for a, b in zip(out, out[1:])]
        while True:
            best = max(gains, default=NO_MERGE)
            if watch:
                watch(best, out)
            if best == NO_MERGE:
                return out
            i = gains.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score.get(out[i - 1] + out[i], NO_MERGE)
            if i < len(gains):
                gains[i] = score.get(out[i] + out[i + 1], NO_MERGE)

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text between two cuts, so that each of its characters is a piece, or it is one character."""
        if len(text) == 1 and text not in self.id:
            return [self.byte_id[b] for b in text.encode()]
        n, many, size, most, fits, longest, shorter = len(text), len(self.pieces), self.size, self.longest, self.fits, self.automaton.iter_long, self.shorter
        failed = None  # once there is one, bit i: from position i on, nothing fits
        out: list[int] = []
        pos, left, piece = 0, -1, -1
        # mostly the longest matches one after the other fit; from the first that doesn't, each is looked for by itself
        for _, piece in longest(text):
            if left >= 0 and not fits[left * many + piece]:
                pos = sum([size[i] for i in out])
                break
            out.append(piece)
            left = piece
        else:
            return out
        while pos < n:
            # the automaton copies what it is given, so it gets no more than a piece can span
            piece = next(longest(text[pos : pos + most]))[1] if piece < 0 else shorter[piece]
            while piece >= 0:
                end = pos + size[piece]
                if not (failed and failed[end >> 3] >> (end & 7) & 1) and (left < 0 or fits[left * many + piece]):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                pos, left, piece = end, piece, -1
            else:
                # nothing fits here: mark the position, and go on with the shorter matches of the piece before,
                # of which there is always one, as the merge rule gives some encoding
                failed = failed or bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= size[piece]
                left = out[-1] if out else -1
        return out

    def _part(self, part: str) -> tuple[bytes, str, int]:
        """Ids as little-endian 32-bit bytes, the decoded characters and the number of byte pieces of a part."""
        if len(part) <= CACHE_LENGTH and self.known.issuperset(part):
            return array("I", self.backtrack(part)).tobytes(), part.replace(SPACE_MARK, " "), 0
        inside = self.inside
        # where no piece holds two neighbouring characters together, no merge crosses
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in inside]
        if cuts:
            units = self.units
            ids = [p for a, b in zip([0, *cuts], [*cuts, len(part)]) for p in units[part[a:b]]]
        else:
            ids = self.backtrack(part)
        surface, most = self.surface, self.last_byte
        return array("I", ids).tobytes(), b"".join([surface[i] for i in ids]).decode("utf-8", "replace"), sum([i <= most for i in ids]) if cuts or ids[0] <= most else 0

    def encode_parts(self, text: str) -> list[tuple[bytes, str, int]]:
        """What _part gives for each part of a text, without begin and end ids."""
        return list(map(self.done.__getitem__, self.parts.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)))) if text else []

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        return self.bos.to_bytes(4, "little") + b"".join([x[0] for x in self.encode_parts(text)]) + self.eos.to_bytes(4, "little")

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """Text of ids: pieces joined, byte pieces decoded together (what is no UTF-8 as U+FFFD), one leading space taken off."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if strip and text[:1] == " " else text


@lru_cache(maxsize=2)
def process_pieces(pieces: tuple[tuple[str, float, int], ...]) -> Pieces:
    return Pieces(pieces)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, model_path: str, keep: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids and decoded.

    Null texts count as empty: begin and end ids only, decoded to the empty
    text. Repeated rows each give a row, empty tables none; extra columns are
    ignored. The model file is read on the driver and its pieces travel with
    the tasks. Characters without a piece become byte pieces, so decoding gives
    the text back, but for U+2581, which decodes to a space.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = process_pieces(shared.value)
        begin, end = p.bos.to_bytes(4, "little"), p.eos.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = p.encode_parts(text or "")
                ids = begin + b"".join([x[0] for x in parts]) + end
                decoded = "".join([x[1] for x in parts])[1:]
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids if keep else None, decoded if keep else None))
            yield pa.RecordBatch.from_pydict(dict(zip(SCHEMA.names, map(list, zip(*rows)))) if rows else {n: [] for n in SCHEMA.names}, schema=SCHEMA)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
    return out if keep else out.drop("ids", "decoded")

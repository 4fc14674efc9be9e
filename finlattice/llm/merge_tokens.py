"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking instead of a queue of merges.

A sequence of pieces is what merging gives if, and only if, each piece and each pair of neighbours is what merging gives
for its own characters: merges inside a stretch happen in the same order whatever stands around it. So the encoder takes
the longest piece at a place (an Aho-Corasick automaton finds all of them in one scan), checks it with its left neighbour
by merging the two again, tries shorter pieces where that fails, and steps back over the last piece where none is left.
A bitfield of failed places makes sure that no place is tried twice, so the work stays in proportion to the text.

Texts are cut only where no merge can reach across: at characters that no piece has and, if no piece holds a word
boundary inside, before it. Short stretches and checked pairs are remembered in each worker, up to a bound of entries.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows, null ids
included; an empty table gives none; a text may be of any length, as ids are made, hashed and decoded in slices; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a remembered stretch, stretches of each of a worker's two generations, its remembered pairs, and ids decoded at once.
SHORT, STRETCHES, PAIRS, SLICE = 48, 400_000, 400_000, 200_000
#: Characters scanned by the automaton at once.
WINDOW = 1 << 16
#: Fixed values of the model file: types of pieces, the type of a merge model, and the sign for a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_MODEL, SPACE = 2, "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message of a model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """The pieces (text, score, type) of a merge model, and whether it falls back to bytes."""
    pieces, trainer = [], {}
    with open(path, "rb") as file:
        for field, value in _fields(file.read()):
            if field == 1:
                parts = dict(_fields(value))
                pieces.append((parts[1].decode(), struct.unpack("<f", parts.get(2, bytes(4)))[0], parts.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
    if trainer.get(3, 1) != MERGE_MODEL:
        raise ValueError("not a merge-type model")
    if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
        raise ValueError("user-defined and unused pieces aren't supported")
    return pieces, bool(trainer.get(35, 0))


class MergeEncoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)  # normalises and decodes
        pieces, self.bytes = read_model(path)
        self.score = {text: score for text, score, kind in pieces if kind == NORMAL}
        self.ids = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.unknown = next(k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.byte_ids = {int(text[1:-1], 16): k for k, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        letters = {c for text in self.ids for c in text}
        single = [c for c in letters if c not in self.ids]  # parts of pieces that aren't pieces themselves
        self.text = [text for text in self.ids if self.merged(text) == [text]] + single
        self.place = {text: n for n, text in enumerate(self.text)}
        self.shorter = [next((self.place[t[:j]] for j in range(len(t) - 1, 0, -1) if t[:j] in self.place), -1) for t in self.text]
        self.out = [self._ids_of(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for n, t in enumerate(self.text):
            self.automaton.add_word(t, (n, len(t) - 1))
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.text]
        self.ends, self.begins = zip(*map(self._edges, self.text))
        self.longest = max(self.size)
        self.first = [x[0] for x in self.out]
        self.decimals = [",".join(map(str, x)) for x in self.out]
        self.plain = all(len(x) == 1 for x in self.out)
        inner = "".join(map(re.escape, sorted(letters - {SPACE})))
        known = f"{SPACE}*[{inner}]+|{SPACE}+"
        if any(SPACE in text.lstrip(SPACE) for text in self.ids):
            known = f"[{SPACE}{inner}]+"
        self.stretch = re.compile(f"{known}|[^{SPACE}{inner}]")
        self.probe = next(t for t in self.ids if len(t) == 1 and t.isascii() and t.isalpha())
        self.memo: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older = self.memo
        self.pairs: dict[int, bool] = {}

    def _ids_of(self, text: str) -> list[int]:
        if text in self.ids:
            return [self.ids[text]]
        return [self.byte_ids[b] for b in text.encode()] if self.bytes else [self.unknown]

    def _merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """The merges of a short text in order, (score, pieces after it): the pair of the highest score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                return
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield best, parts

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text."""
        parts = list(text)
        for _, parts in self._merges(text):
            pass
        return parts

    def _edges(self, text: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]]:
        """For each merge of a piece its score, and the part that then stands at the end, or at the beginning, of the piece."""
        steps = [(score, parts[-1], parts[0]) for score, parts in self._merges(text)]
        return [(s, last) for s, last, _ in steps], [(s, first) for s, _, first in steps]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their characters are merged again; remembered.

        What both do inside is known, so only their merges' order is replayed, beside the pair that meets at the border.
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ends, begins, score = self.ends[left], self.begins[right], self.score
        u, v = self.text[left][-1], self.text[right][0]
        i = j = 0
        fits = True
        while True:
            across = score.get(u + v)
            a = ends[i][0] if i < len(ends) else None
            b = begins[j][0] if j < len(begins) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                fits = False
                break
            if a is None and b is None:
                break
            if b is None or (a is not None and a >= b):
                u = ends[i][1]
                i += 1
            else:
                v = begins[j][1]
                j += 1
        self.pairs[left << 32 | right] = fits
        return fits

    def _longest_at(self, text: str, start: int) -> list[int]:
        """The longest piece that starts at each place of a window of the text."""
        part = text if len(text) <= WINDOW else text[start : start + WINDOW + self.longest - 1]
        best = [-1] * len(part)
        for end, (piece, back) in self.automaton.iter(part):  # ends ascend, so the last one seen at a place is the longest
            best[end - back] = piece
        return best[:WINDOW]

    def pieces_of(self, text: str) -> list[int]:
        """Places in self.text of the pieces of a stretch whose characters are all known."""
        best = self._longest_at(text, 0)
        size, shorter, pairs = self.size, self.shorter, self.pairs
        failed = bytearray(len(text) // 8 + 1)
        any_failed = False
        taken: list[int] = []
        at, n, last = 0, len(text), -1
        piece = best[0]
        while True:
            while piece >= 0:
                end = at + size[piece]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | piece)
                    if self._fits(last, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece < 0:  # no piece leads on from here: step back, and try a shorter one there
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = taken.pop()
                at -= size[piece]
                last = taken[-1] if taken else -1
                piece = shorter[piece]
                continue
            taken.append(piece)
            if end >= n:
                return taken
            at, last = end, piece
            while at >= len(best):
                best += self._longest_at(text, len(best))
            piece = best[at]

    def _stretch_ids(self, stretch: str) -> tuple[tuple[int, ...], str]:
        """A stretch that the younger generation doesn't know: from the older one, or worked out."""
        known = self.older.get(stretch)
        if known is None:
            if stretch[0] not in self.place:
                ids = self._ids_of(stretch)
                known = (tuple(ids), ",".join(map(str, ids)))
            else:
                places = self.pieces_of(stretch)
                decimals = ",".join(map(self.decimals.__getitem__, places))
                if self.plain:
                    known = (tuple(map(self.first.__getitem__, places)), decimals)
                else:
                    known = (tuple(chain.from_iterable(map(self.out.__getitem__, places))), decimals)
        if len(stretch) <= SHORT:
            if len(self.memo) >= STRETCHES:
                self.memo, self.older = {}, self.memo
            self.memo[stretch] = known
        return known

    def encode(self, text: str) -> tuple[list[int], list[str]]:
        """The ids of a text, and their decimals: joined by commas they are those of all ids."""
        text = self.library.normalize(text)
        ids: list[int] = []
        decimals: list[str] = []
        if len(text) <= SLICE:
            self._encode(self.stretch.findall(text), ids, decimals)
        else:
            stretches = (m[0] for m in self.stretch.finditer(text))
            while part := list(islice(stretches, SLICE)):
                more: list[str] = []
                self._encode(part, ids, more)
                decimals.append(",".join(more))
        return ids, decimals

    def _encode(self, stretches: list[str], ids: list[int], decimals: list[str]) -> None:
        known = list(map(self.memo.get, stretches))
        if None in known:
            known = [k or self.memo.get(s) or self._stretch_ids(s) for k, s in zip(known, stretches)]
        if not self.bytes:  # neighbouring unknown characters count as one
            unknown = (self.unknown,)
            before = ids[-1:] == [self.unknown]
            kept = []
            for k in known:
                if k[0] != unknown or not before:
                    kept.append(k)
                before = k[0] == unknown
            known = kept
        ids.extend(chain.from_iterable([k[0] for k in known]))
        decimals.extend([k[1] for k in known])

    def decode(self, ids: list[int]) -> Iterator[str]:
        """The text of ids, in slices that don't cut a run of byte pieces."""
        bytes_, at = set(self.byte_ids.values()), 0
        while at < len(ids):
            stop = min(len(ids), at + SLICE)
            while stop < len(ids) and ids[stop] in bytes_:
                stop += 1
            if at == 0:
                yield self.library.decode(ids[:stop])
            else:  # a letter in front, as a space is dropped only where a text begins
                yield self.library.decode([self.ids[self.probe], *ids[at:stop]])[1:]
            at = stop


@lru_cache(2)
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def tokenize(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded, for each row of doc_id and text.

    model: the path of a merge-type model, the same on all executors. The sums are of the decimal ids joined by commas and
    of the decoded text in UTF-8.
    """
    path = model or default_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        rows: list[tuple] = []
        for text in batch.column("text"):
            ids, decimals = coder.encode(text.as_py() or "")
            back = hashlib.sha256()
            parts = []
            for part in coder.decode(ids):
                back.update(part.encode())
                if with_ids:
                    parts.append(part)
            rows.append((len(ids), hashlib.sha256(",".join(decimals).encode()).hexdigest(), back.hexdigest(), ids if with_ids else None, "".join(parts)))
        n, sums, backs, ids, texts = zip(*rows)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums), pa.array(backs)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def detokenize(tokens: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, decoded: the texts of lists of ids, null where the list is null."""
    path = model or default_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        out = [None if x is None else "".join(coder.decode(x)) for x in (row.as_py() for row in batch.column("ids"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return common.map_arrow(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")), run, "doc_id long, decoded string")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

"""SentencePiece encoding with byte offsets, and decoding.

Normalisation follows the compiled character map: at each place the longest key of its
double-array trie is replaced, else one character is copied, and every normalised byte
remembers the source byte it came from.  The piece model then splits the normalised
text, and each piece's normalised span is projected to a span of original UTF-8 bytes.

One path serves all models that keep spaces: only places whose byte can begin a key of the
map are looked up in the trie, the runs between them are copied whole, and the alignment is
an array operation.  A model without keys has no such places.  Models that squeeze spaces
take the character-wise path.

Cases: a null text counts as empty and has no pieces; repeated rows are encoded one by
one; the pieces' spans tile the text (a span is empty where the model adds a space of
its own).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnlight.llm import shared

SPACE = "▁"


class CharsMap:
    """The compiled character map of a model: longest-prefix replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :]
        #: Bytes that begin a key, and as a pattern.
        self.first = np.zeros(256, bool)
        if self.units:
            root = self._child(self.units[0])
            for b in range(1, 256):
                self.first[b] = root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


def _char_end(data: bytes, at: int) -> int:
    lead = data[at]
    return at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)


def normalise(text: str, chars: CharsMap, dummy_prefix: bool, squeeze: bool, escape: bool = True) -> tuple[bytes, np.ndarray]:
    """Normalised bytes and, for each of them and the end, its source byte offset."""
    data, out, at = text.encode(), bytearray(), []
    mark = SPACE.encode() if escape else b" "

    def put(piece: bytes, source: int) -> None:
        out.extend(piece)
        at.extend([source] * len(piece))

    steps, i = [], 0
    while i < len(data):
        hit = chars.longest(data, i)
        if hit:
            steps.append((i, hit[1]))
            i += hit[0]
        else:
            j = _char_end(data, i)
            steps.append((i, data[i:j]))
            i = j
    last = len(data)
    if squeeze:
        while steps and not steps[-1][1].strip(b" "):
            last = steps.pop()[0]
        k = 0
        while k < len(steps) and not steps[k][1].strip(b" "):
            k += 1
        steps = steps[k:]
    if steps and dummy_prefix:
        put(mark, steps[0][0])
    spaced = squeeze
    for source, piece in steps:
        if squeeze and spaced:
            piece = piece.lstrip(b" ")
        if not piece:
            continue
        put(piece.replace(b" ", mark), source)
        spaced = piece.endswith(b" ")
    if squeeze:
        while out.endswith(mark):
            del out[-len(mark) :]
            last = at[-len(mark)]
            del at[-len(mark) :]
    return bytes(out), np.array([*at, last], np.int64)


def alignment(text: str, chars: CharsMap, dummy_prefix: bool) -> np.ndarray:
    """The source byte of each normalised byte and of the end, where spaces are kept and escaped.

    Equals ``normalise(...)[1]`` without squeezing.
    """
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    wide = len(SPACE.encode())
    # normalised bytes that stand for each source byte; a replacement stands on its first one
    many = np.where(raw == 32, wide, 1)
    upto = 0
    for i in np.flatnonzero(chars.first[raw]).tolist() if chars.units else ():
        if i < upto:
            continue
        hit = chars.longest(data, i)
        if hit:
            upto = i + hit[0]
            many[i:upto] = 0
            many[i] = len(hit[1]) + (wide - 1) * hit[1].count(b" ")
        else:
            upto = _char_end(data, i)
    if chars.units:  # all bytes of a copied character come from its first one
        lead = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)) if len(raw) else raw
    else:
        lead = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0)) if (raw >= 0x80).any() else np.arange(len(raw))
    source = np.repeat(lead, many)
    head = [0] * wide if dummy_prefix and len(source) else []
    return np.concatenate([np.array(head, np.int64), source, [len(data)]]).astype(np.int64)


class Encoder:
    """A piece model with offsets."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        self.chars = CharsMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.unknown = self.lib.unk_id()
        self.size = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)

    def _sizes(self, text: str, ids: list[int]) -> list[int]:
        """Normalised bytes of each piece."""
        if self.unknown in ids:
            return [len(p.piece.encode()) if p.id == self.unknown else int(self.size[p.id]) for p in self.lib.encode(text, return_type="proto").pieces]
        return self.size[ids].tolist()

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and span bounds: piece i covers the bytes ``bounds[i]:bounds[i + 1]``."""
        ids = self.lib.encode(text)
        if self.squeeze:
            _, source = normalise(text, self.chars, self.dummy, True)
        else:
            source = alignment(text, self.chars, self.dummy)
        ends = np.cumsum(self._sizes(text, ids)) if ids else np.zeros(0, np.int64)
        return ids, source[np.concatenate([[0], ends]).astype(np.int64)]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids) if ids else ""


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """All columns of ``docs`` with the pieces of the text, in one narrow pass.

    Adds ``n_tokens``, ``ids``, ``starts`` and ``ends`` (original bytes, end exclusive)
    and ``decoded``; with ``digest`` the arrays and the decoded text are replaced by
    ``ids_sha256``, ``decoded_sha256`` and ``n_covered``, the bytes under the spans.
    """
    shared.tune(docs.sparkSession)
    box = shared.boxed(docs, text_col)
    more = [("ids_sha256", "string"), ("decoded_sha256", "string"), ("n_covered", "long")] if digest else [("ids", "array<int>"), ("starts", "array<int>"), ("ends", "array<int>"), ("decoded", "string")]
    added = ["n_tokens", *[n for n, _ in more]]

    def lists(parts):
        """Arrays of 32-bit numbers as one list column."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))

    def work(stream):
        coder = encoder(model_path)
        names_of = [str(i) for i in range(len(coder.size))]
        for batch in stream:
            for part in shared.slices(batch):
                counts, rows = [], []
                for text in part.column("text").to_pylist():
                    ids, bounds = coder.encode(text or "")
                    counts.append(len(ids))
                    decoded = coder.decode(ids)
                    if digest:
                        rows.append((hashlib.sha256(",".join([names_of[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(bounds[-1] - bounds[0])))
                    else:
                        rows.append((np.array(ids, np.int32), bounds[:-1], bounds[1:], decoded))
                cols = [pa.array(c) if digest or i == 3 else lists(c) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), *cols], ["row", "text", *added])

    out = box.mapInArrow(work, shared.boxed_schema(box, n_tokens="long", **dict(more)))
    return shared.unboxed(out, docs, text_col, added)

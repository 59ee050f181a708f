"""SentencePiece encoding that keeps every piece's place in the source bytes.

A text is normalised through the model's compiled character map (a double-array
trie over UTF-8): at each byte the longest prefix in the map is replaced, and the
source offset of every normalised byte is recorded. The normalised text is cut
where no piece of the vocabulary can reach across, each segment is encoded once
per worker by the library, and the pieces' byte lengths, added up, are projected
through the recorded offsets to spans of the source.

Defined results: a null text counts as empty and has no pieces. Texts are encoded
whole, however long. Repeated rows each get a row. A null doc_id is kept. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, small_batches, table

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------- model file


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, message[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield number, message[at : at + n]
            at += n


class CharMap:
    """The compiled character map: a double-array trie, then its replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        self.units: np.ndarray | list = []
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``text[at:]`` and what replaces it."""
        units = self.units
        if not units:
            return None
        found = None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, value
        if found is None:
            return None
        n, value = found
        return n, self.replacements[value : self.replacements.index(b"\0", value)]


class Normalizer:
    """The model's normalisation, with the source offset of every byte that it puts out."""

    def __init__(self, spec: bytes) -> None:
        got = dict(_fields(spec))
        self.map = CharMap(got.get(2, b""))
        self.dummy_prefix = bool(got.get(3, 1))
        self.strip = bool(got.get(4, 1))
        self.escape = bool(got.get(5, 1))
        self.plain = not self.map.units and not self.strip and self.escape

    def __call__(self, text: str) -> str:
        """The normalised text only."""
        if self.plain:
            return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte where it begins."""
        raw = text.encode("utf-8", "surrogatepass")
        if self.plain:
            if not raw:
                return "", np.zeros(1, np.int64)
            source = np.frombuffer(raw, np.uint8)
            offsets = np.repeat(np.arange(len(raw)), np.where(source == 0x20, 3, 1))
            lead = np.zeros(3 if self.dummy_prefix else 0, np.int64)
            return self(text), np.concatenate([lead, offsets, [len(raw)]])
        out, offsets = bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        steps = []
        at = 0
        while at < len(raw):
            mapped = self.map.longest(raw, at)
            if mapped is None:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                mapped = n, raw[at : at + n]
            steps.append((at, *mapped))
            at += mapped[0]
        if self.strip:
            first = next((i for i, s in enumerate(steps) if s[2] != b" "), len(steps))
            steps = steps[first:]
        if not steps:
            return "", np.array([0])
        if self.dummy_prefix:
            out += space
            offsets += [steps[0][0]] * len(space)
        after_space = self.strip
        for at, n, new in steps:
            if after_space:
                new = new.lstrip(b" ")
            for byte in new:
                put = space if byte == 0x20 else bytes([byte])
                out += put
                offsets += [at] * len(put)
            if new:
                after_space = self.strip and new.endswith(b" ")
        end = steps[-1][0] + steps[-1][1]
        if self.strip:
            while out.endswith(space):
                del out[-len(space) :]
                end = offsets[-len(space)]
                del offsets[-len(space) :]
        return out.decode("utf-8", "replace"), np.array([*offsets, end])


class Segments(dict):
    """Segment -> what ``encode`` makes of it; starts anew when it holds ``most`` entries."""

    def __init__(self, encode, most: int = 400_000) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, segment: str):
        value = self.encode(segment)
        if len(segment) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[segment] = value
        return value


class Encoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            model = file.read()
        self.normalizer = Normalizer(next((v for k, v in _fields(model) if k == 3), b""))
        self.whole = SentencePieceProcessor(model_proto=model)
        # later fields of a message win: the same model without any normalisation
        self.bare = SentencePieceProcessor(model_proto=model + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        #: Bytes of each piece in the normalised text; an unknown piece has none of its own.
        self.sizes = [0 if self.whole.is_unknown(i) else 1 if self.whole.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)]
        self.bytes_of = [int(p[3:5], 16) if self.whole.is_byte(i) else None for i, p in enumerate(pieces)]
        reach = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.segments = re.compile(r"[\s\S]+" if reach else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known = Segments(self._segment)

    def _segment(self, segment: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        ids = tuple(self.bare.encode(segment))
        if 0 not in map(self.sizes.__getitem__, ids):
            return ids, tuple(map(self.sizes.__getitem__, ids))
        pieces = self.bare.encode(segment, out_type="immutable_proto").pieces
        return tuple(p.id for p in pieces), tuple(len(p.surface.encode()) for p in pieces)

    def ids(self, text: str) -> list[int]:
        known = self.known
        return list(chain.from_iterable(known[s][0] for s in self.segments.findall(self.normalizer(text))))

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and for each the first source byte and the one after its last."""
        normal, offsets = self.normalizer.aligned(text)
        found = [self.known[s] for s in self.segments.findall(normal)]
        ids = list(chain.from_iterable(f[0] for f in found))
        ends = np.fromiter(accumulate(chain.from_iterable(f[1] for f in found)), np.int64, len(ids))
        cut = offsets[np.concatenate([[0], ends])] if len(ids) else np.zeros(1, np.int64)
        return ids, cut[:-1], cut[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------- operators

SPANS = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType() if n == "ids" else T.LongType())) for n in ("ids", "begins", "ends")])


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends): piece i covers bytes begins[i] to ends[i] of the text."""
    model = model or default_model()
    small_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(text: pd.Series) -> pd.DataFrame:
        use = encoder(model)
        return pd.DataFrame([use.encode(t or "") for t in text], columns=["ids", "begins", "ends"])

    return docs.select(column(id_col).alias("doc_id"), spans(column(text_col)).alias("e")).select("doc_id", "e.*")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``."""
    model = model or default_model()

    @F.pandas_udf(T.StringType())
    def text_of(ids: pd.Series) -> pd.Series:
        use = encoder(model).whole
        return pd.Series([use.decode([int(i) for i in x]) if x is not None else "" for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of(column(ids_col)))


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("source_bytes", T.LongType())])


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row digests of what ``encode`` and ``decode`` give, made where they are made.

    ``source_bytes`` is the end of the last span.
    """
    model = model or default_model()
    small_batches(docs.sparkSession)

    @F.pandas_udf(DIGESTS)
    def digest(text: pd.Series) -> pd.DataFrame:
        use = encoder(model)
        names = [str(i) for i in range(len(use.sizes))]
        rows = []
        for t in text:
            ids, _, ends = use.encode(t or "")
            listed = ",".join(map(names.__getitem__, ids)).encode()
            back = use.whole.decode(ids).encode("utf-8", "surrogatepass")
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest(), int(ends[-1]) if len(ends) else 0))
        return pd.DataFrame(rows, columns=[f.name for f in DIGESTS])

    return docs.select(column(id_col).alias("doc_id"), digest(column(text_col)).alias("d")).select("doc_id", "d.*")


def op5_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_piece_encode": op5_piece_encode}
ORACLES: dict[str, str] = {}
